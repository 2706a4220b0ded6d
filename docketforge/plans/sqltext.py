"""The text functions once more as SQL for a second engine whose regular expressions lack look-around."""

from __future__ import annotations

from docketforge.functions import text as T

SOLID = T.SOLID


def words(x: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(coalesce({x}, ''), '[\\[\\]]', '', 'g')), '{T.TOKEN}')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{SOLID}+'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{T.SPACE}+', ' ', 'g'))"


def normalised(x: str) -> str:
    plain = squeeze("translate(coalesce(" + x + ", ''), '" + T.VARIANTS + "', '" + T.PLAIN.replace("'", "''") + "')")
    once = rf"regexp_replace({plain}, '\b([A-Z])\. +([A-Z]\.)', '\1.\2', 'g')"
    return rf"regexp_replace({once}, '\b([A-Z])\. +([A-Z]\.)', '\1.\2', 'g')"


def stream(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}§]', '', 'g')"


def blanked(x: str) -> str:
    t = f"coalesce({x}, '')"
    for n in (1, 2, 3):
        t = rf"""regexp_replace({t}, '([.,;:”"''])[0-9]{{{n}}}([ \t\n\r\f\v]|$)', '\1{' ' * n}\2', 'g')"""
    for gap in (1, 0):
        for n in (4, 3, 2, 1):
            t = rf"regexp_replace({t}, '\*{'[ \t\n\r\f\v]' * gap}[0-9]{{{n}}}', '{' ' * (1 + gap + n)}', 'g')"
    for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
        for n in (4, 3, 2, 1):
            t = rf"regexp_replace({t}, '\[{'[ \t\n\r\f\v]' * a}[0-9]{{{n}}}{'[ \t\n\r\f\v]' * b}\]', '{' ' * (2 + a + b + n)}', 'g')"
    return t


def ascii_stream(x: str) -> str:
    t = rf"""regexp_replace(coalesce({x}, ''), '([.,;:”"''])[0-9]{{1,3}}([ \t\n\r\f\v]|$)', '\1 \2', 'g')"""
    t = rf"regexp_replace(regexp_replace({t}, '\*[ \t\n\r\f\v]?[0-9]{{1,4}}', ' ', 'g'), '\[[ \t\n\r\f\v]?[0-9]{{1,4}}[ \t\n\r\f\v]?\]', ' ', 'g')"
    return f"regexp_replace(lower({t}), '[^a-z0-9§]', '', 'g')"


def sanitised(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{FFFE}}\x{{FFFF}}]', ' ', 'g')"


def clean_text(x: str) -> str:
    t = rf"regexp_replace(coalesce({x}, ''), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}]', '', 'g')"
    t = rf"regexp_replace({t}, '\[ *[Ff]ootnote +[0-9]+ *\]', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n[ \t\n\r]*\*?[0-9]{{1,4}}[ \t\n\r]*\n', chr(10), 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


def citation_key(x: str) -> str:
    p = r"([0-9]+) +U\.? ?S\.? +([0-9]+)"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', 1) || '-' || regexp_extract({x}, '{p}', 2) END"


def plain_name(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '\b(?:{'|'.join(T.NOISE_WORDS)})\b', ' ', 'g'), ' +', ' ', 'g'))"


def name_key(x: str) -> str:
    sides = rf"string_split(regexp_replace(coalesce({x}, ''), '(?i)\bvs?\b\.?', chr(1), 'g'), chr(1))"
    tail = T.NAME_TAIL
    lead = lambda i: f"list_filter(string_split({plain_name(f'''regexp_replace({sides}[{i}], '{tail}', '')''')}, ' '), lambda w: length(w) > 2)[1:2]"
    return f"array_to_string(list_sort(list_concat({lead(1)}, {lead(2)})), ' ')"


def starts_yes_no(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({x}, ''), '{SOLID}+')), '[^a-z]', '', 'g') IN ('yes', 'no', 'true', 'false')"


def alpha(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+')"


def overlap_ratio(a: str, b: str) -> str:
    return f"CASE WHEN len({alpha(a)}) > 0 THEN len(list_filter({alpha(a)}, lambda w: list_contains({alpha(b)}, w))) / len({alpha(a)}) ELSE 0.0 END"

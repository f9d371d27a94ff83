"""The text functions as DuckDB expressions, for the SQL twins of queries."""

SPACE = r"[ \t\n\x0B\f\r]"
BIDI = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, new in pairs:
        x = f"regexp_replace({x}, '{pattern}', {new if new.startswith('chr(') else f"'{new}'"}, 'g')"
    return x


def strip(x: str) -> str:
    return replaced(x, (f"^{SPACE}+", ""), (f"{SPACE}+$", ""))


def flat(x: str) -> str:
    return strip(replaced(x, (f"{SPACE}+", " ")))


def clean(x: str) -> str:
    bare = replaced(f"coalesce({x}, '')", (BIDI, ""), (CONTROLS, ""), (r"\r", ""))
    return strip(replaced(bare, (r"[ \t]+", " "), (" *\n *", "chr(10)"), ("\n{3,}", "chr(10) || chr(10)")))


def fold(x: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({x}, '')), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), 'إأآٱـ', 'اااا')"


def letters_only(x: str) -> str:
    digits = f"translate({clean(x)}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
    return strip(replaced(f"lower({digits})", (r"[^a-z0-9\x{0621}-\x{063A}\x{0641}-\x{064A}]+", " ")))


def tokens(x: str, least: int = 2) -> str:
    return f"list_filter(string_split({letters_only(x)}, ' '), lambda w: length(w) >= {least})"


def rule_fold(x: str) -> str:
    bare = replaced(f"coalesce({x}, '')", (r"[\x{064B}-\x{0652}\x{0670}\x{0640}]", ""), (r"[-–—:،,؛;.()\[\]{}«»\"''’“”]", " "))
    return f"lower({flat(bare)})"


def word_fold(x: str) -> str:
    return f"lower({flat(replaced(f'coalesce({x}, chr(32))', (r'[^\p{L}\p{N}]+', ' ')))})"


def round_half_up(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def digit_runs(x: str) -> str:
    return f"list_transform(regexp_extract_all(translate(coalesce({x}, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+(?:[.,٫][0-9]+)*'), lambda v: regexp_replace(v, '[.,٫]', '', 'g'))"


def compact(x: str, most: int) -> str:
    text = flat(clean(x))
    return f"(SELECT CASE WHEN length(t) <= {most} THEN t ELSE {strip(f'CASE WHEN length(h) > {most} / 2.0 THEN h ELSE c END')} END FROM (SELECT t, substr(t, 1, {most}) AS c, regexp_extract(substr(t, 1, {most}), '^(.*)[ ،.؛؟!:,][^ ،.؛؟!:,]*$', 1) AS h FROM (SELECT {text} AS t)))"


def clip_at_word(x: str, most: int = 140, share: float = 0.6) -> str:
    cut = f"substr(t, 1, {most})"
    head = f"regexp_extract({cut}, '(?s)^(.*) [^ ]*$', 1)"
    return f"(SELECT CASE WHEN length(t) <= {most} THEN t ELSE {strip(f'CASE WHEN length({head}) > {most * share:g} THEN {head} ELSE {cut} END')} END FROM (SELECT {clean(x)} AS t))"


def escaped(pattern: str) -> str:
    """A pattern inside a SQL string."""
    return pattern.replace("'", "''")


def damaged(x: str) -> str:
    """What ``text.is_damaged`` finds at its default limits."""
    noise = r"[^\x21-\x7E\x{00A0}-\x{024F}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{2000}-\x{22FF}\x{E000}-\x{F8FF}]"
    mixed = f"len(list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda w: regexp_matches(w, '[\\x{{0621}}-\\x{{064A}}]') AND regexp_matches(w, '[A-Za-z]')))"
    private = r"[\x{0621}-\x{064A}][\x{E000}-\x{F8FF}]|[\x{E000}-\x{F8FF}][\x{0621}-\x{064A}]"
    return f"(SELECT contains(t, chr(65533)) OR regexp_matches(t, '{private}') OR {mixed} >= 2 OR (length(v) >= 40 AND len(regexp_extract_all(v, '{noise}')) / greatest(length(v), 1) >= 0.02) FROM (SELECT t, regexp_replace(t, '{SPACE}+', '', 'g') AS v FROM (SELECT {x} AS t)))"

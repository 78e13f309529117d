"""Secret scans with DataFrame functions alone: patterns, and windowed entropy.

Base kinds are patterns matched from left to right without overlap; a match
that fails its length check is dropped after it has been passed over. The
entropy kinds look at candidate strings (maximal runs of a character class):
a window slides over the candidate, the counts of its characters are updated
by the one that enters and the one that leaves, and the candidate is a finding
if some window reaches the class's Shannon entropy. The allow-list has patterns
that name a candidate as a whole, and words: a candidate ends where one
begins and a new one begins behind it, so only windows that touch the word are
suppressed. Positions are code points, the end exclusive.

Edge cases: a null text counts as empty; a text without findings has empty
arrays; repeated rows and null ids give one row each; an empty table gives no
rows; other columns are not looked at (:func:`redact` keeps them all).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import free_name, id_and_text

# Fixed values of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short has no longer match inside, so the length may stand in these patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

MARK = "<secret>"
#: Counts are weighed in this many parts of a bit, as whole numbers: no rounding adds up along a candidate.
SCALE = 1 << 24


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``run_class`` of at least ``window`` characters, all from ``alphabet``."""

    kind: str
    run_class: str
    alphabet: str
    window: int
    least_bits: float
    must_have: tuple[str, ...] = ()


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", _DIGITS + "abcdefABCDEF", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", _UPPER + _LOWER + _DIGITS + "+/_=-", 20, 3.9, ("[0-9]", "[A-Za-z]")),
)
#: Patterns of whole candidates that look random and are no secrets.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-_=]",
)
#: Words (in any case) that no window may touch.
ALLOW_WORDS = ("placeholder", "changeme", "abcdefgh", "01234567", "qwertyui", "example", "sample", "dummy")
_GAP = " "  # in no class


def _lit(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _spans(text: str, pattern: str, keep: str, group: int = 0) -> str:
    """SQL: array of (s, e) of the matches for which ``keep`` holds (of ``x.m``, and ``x.g``, the group).

    The pieces between the matches and the matches themselves, laid end to
    end, are the text: running lengths give the positions.
    """
    rx = _lit(pattern)
    none = "CAST(array() AS array<struct<s:int,e:int>>)"
    return f"""CASE WHEN {text} RLIKE {rx} THEN aggregate(
        zip_with(split({text}, {rx}, -1),
                 zip_with(regexp_extract_all({text}, {rx}, 0), regexp_extract_all({text}, {rx}, {group}),
                          (m, g) -> named_struct('m', m, 'g', g)),
                 (p, x) -> named_struct('p', p, 'm', x.m, 'g', x.g)),
        named_struct('at', 0, 'out', {none}),
        (acc, x) -> named_struct(
            'at', acc.at + length(x.p) + coalesce(length(x.m), 0),
            'out', CASE WHEN x.m IS NOT NULL AND {keep} THEN concat(acc.out, array(named_struct(
                's', acc.at + length(x.p), 'e', acc.at + length(x.p) + length(x.m)))) ELSE acc.out END),
        acc -> acc.out) ELSE {none} END"""


def _reaches(cand: str, c: CharClass) -> str:
    """SQL: whether some window of the string ``cand`` has ``c.least_bits`` of entropy.

    H = log2(w) - sum(n log2 n) / w over the counts n of the window. As the
    window moves, the sum changes by table entries of the two characters that
    enter and leave, and so do their counts ``n``; ``t`` is the sum, ``low`` its
    lowest value over the full windows before.
    """
    w = c.window
    weight = "array(" + ",".join(f"{round(n * math.log2(n) * SCALE) if n else 0}L" for n in range(w + 1)) + ")"
    most = math.floor((math.log2(w) - c.least_bits) * w * SCALE)
    codes = f"transform(split({cand}, ''), ch -> instr('{c.alphabet}', ch) - 1)"
    left = f"slice(concat(array_repeat(-1, {w}), {codes}), 1, length({cand}))"
    return f"""aggregate(
        zip_with({codes}, {left}, (new, old) -> named_struct('new', new, 'old', old)),
        named_struct('i', 0, 'n', array_repeat(0, {len(c.alphabet)}), 't', 0L, 'low', CAST(NULL AS bigint)),
        (a, q) -> named_struct(
            'i', a.i + 1,
            'n', CASE WHEN q.new = q.old THEN a.n ELSE transform(a.n, (n, j) ->
                 n + CASE WHEN j = q.new THEN 1 WHEN j = q.old THEN -1 ELSE 0 END) END,
            't', CASE WHEN q.new = q.old THEN a.t
                 ELSE a.t + {weight}[a.n[q.new] + 1] - {weight}[a.n[q.new]]
                      + CASE WHEN q.old >= 0 THEN {weight}[a.n[q.old] - 1] - {weight}[a.n[q.old]] ELSE 0L END END,
            'low', CASE WHEN a.i >= {w} THEN least(a.low, a.t) ELSE a.low END),
        a -> least(a.low, a.t)) <= {most}L"""


def _masked(text: str, words: tuple[str, ...]) -> str:
    """SQL: ``text`` with a gap of the same length for each of the words (letters, digits), so that positions stay."""
    if not words:
        return text
    masked = text
    for n in sorted({len(w) for w in words}, reverse=True):
        masked = f"regexp_replace({masked}, {_lit('(?i)' + '|'.join(w for w in words if len(w) == n))}, '{_GAP * n}')"
    return f"CASE WHEN {text} RLIKE {_lit('(?i)' + '|'.join(words))} THEN {masked} ELSE {text} END"


def _entropy_keep(c: CharClass, allow: tuple[str, ...]) -> str:
    tests = [f"x.m RLIKE {_lit(p)}" for p in c.must_have] + [f"NOT x.m RLIKE {_lit(p)}" for p in allow]
    # the window sum is looked at only where the cheaper tests hold
    return f"CASE WHEN {' AND '.join(tests or ['true'])} THEN {_reaches('x.m', c)} ELSE false END"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
         allow_words: tuple[str, ...] = ALLOW_WORDS) -> DataFrame:
    """``doc_id``, ``text`` and an array ``spans`` of (start, rank, kind, end), sorted.

    Kinds rank as assign, access, hex, then ``classes`` in their order.
    """
    found = id_and_text(docs, id_col, text_col).withColumn("masked", F.expr(_masked("text", allow_words)))
    return found.withColumn("spans", F.expr(_all_spans("text", "masked", classes, allow))).drop("masked")


def _all_spans(text: str, masked: str, classes: tuple[CharClass, ...], allow: tuple[str, ...]) -> str:
    kinds = [("assign", _spans(text, ASSIGN, f"length(x.g) >= {ASSIGN_LEAST}", 2)),
             ("access", _spans(text, ACCESS, "true")), ("hex", _spans(text, HEX, "true"))]
    kinds += [(c.kind, _spans(masked, f"{c.run_class}{{{c.window},}}", _entropy_keep(c, allow))) for c in classes]
    parts = [f"transform({sql}, y -> named_struct('start', y.s, 'rank', {rank}, 'kind', '{kind}', 'end', y.e))"
             for rank, (kind, sql) in enumerate(kinds)]
    return f"array_sort(concat({', '.join(parts)}))"


def digest(found: DataFrame) -> DataFrame:
    """One row per row of :func:`scan`: counts by base kind, the base spans' SHA-256, all spans as text."""
    told = "array_join(transform({}, y -> concat_ws(':', y.kind, y.start, y.end)), ',')"
    count = "CAST(size(filter(spans, y -> y.rank {})) AS bigint)"
    return found.select(
        "doc_id",
        *[F.expr(count.format(f"= {r}")).alias(f"n_{k}") for r, k in enumerate(("assign", "access", "hex"))],
        F.sha2(F.expr(told.format("filter(spans, y -> y.rank <= 2)")), 256).alias("base_sha256"),
        F.expr(told.format("spans")).alias("spans"),
        F.expr(count.format("> 2")).alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars",
           classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
           allow_words: tuple[str, ...] = ALLOW_WORDS, mark: str = MARK) -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark``.

    All rows and columns stay; a row without findings is left as it is (a
    null text stays null). ``length_col``, where the table has it, follows the new text.
    """
    spans, own, masked = free_name(docs, "found_spans"), free_name(docs, "own_text"), free_name(docs, "masked_text")
    df = docs.withColumn(own, F.col(f"`{text_col}`").cast("string")).withColumn(masked, F.expr(_masked(f"`{own}`", allow_words)))
    df = df.withColumn(spans, F.expr(f"CASE WHEN `{own}` IS NOT NULL THEN {_all_spans(f'`{own}`', f'`{masked}`', classes, allow)} END"))
    clean = F.expr(f"""aggregate(`{spans}`,
        named_struct('at', 0, 'out', CAST(array() AS array<string>)),
        (a, y) -> CASE WHEN y.start < a.at THEN named_struct('at', greatest(a.at, y.end), 'out', a.out)
            ELSE named_struct('at', y.end, 'out', concat(a.out, array(substring(`{own}`, a.at + 1, y.start - a.at)))) END,
        a -> array_join(concat(a.out, array(substring(`{own}`, a.at + 1))), '{mark}'))""")
    hit = F.size(spans) > 0
    new = {text_col: F.when(hit, clean).otherwise(F.col(f"`{own}`"))}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(hit, F.length(clean).cast(kind)).otherwise(F.col(f"`{length_col}`"))
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])

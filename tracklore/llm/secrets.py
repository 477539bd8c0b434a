"""Secret scans with SQL functions only: patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import unused


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base kinds, in the order in which spans with the same start are listed. Runs of access and
#: hex are as long as they can be, so too short ones need no match.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Whether a text can hold a match that counts, found faster than all its matches.
_HINTS = {
    "assign": r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
ENTROPY = "entropy"
#: Characters of candidate strings, and the window that slides over them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Character classes with the least entropy, in bits a character, of a suspicious window.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.8))
#: Suspicious spans that hold one of these are placeholders, links or identifiers, not secrets.
ALLOWED = r"(?i:example|sample|dummy|placeholder|change_?me|your_|xxxx|lorem|https?|www|0123456789|abcdefgh|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-)"
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
#: Matches that are placed in one fold, which copies what it has for each.
_FOLD = 256


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _places(text: Column, pattern: str, group: int) -> Column:
    """(start, end, group's text) of each match: matches and the gaps between them alternate.

    Places are running sums, folded chunk by chunk, so that the work stays in proportion to the text.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size")))
    both = F.zip_with(sizes, part, lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), p.alias("part")))
    matches = F.filter(both, lambda m: m["size"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")

    def place(start: Column, some: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(start.alias("at"), none.alias("found")),
            lambda a, m: F.struct(
                (a["at"] + m["gap"] + m["size"]).alias("at"),
                F.array_append(
                    a["found"],
                    F.struct(
                        (a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["size"]).alias("end"), m["part"].alias("part")
                    ),
                ).alias("found"),
            ),
        )

    def chunks(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(_FOLD))
        return F.transform(starts, lambda i: F.slice(found, i + 1, F.lit(_FOLD)))

    def fold(found: Column) -> Column:
        return F.aggregate(
            chunks(found),
            F.struct(F.lit(0).alias("at"), F.array(none).alias("found")),
            lambda a, some: _once(
                place(a["at"], some), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["found"], x["found"]).alias("found"))
            ),
            lambda a: F.flatten(a["found"]),
        )

    return _once(matches, lambda found: F.when(F.size(found) > 0, fold(found)).otherwise(none))


def _base(text: Column, number: int, rule: Rule) -> Column:
    found = F.filter(_places(text, rule.pattern, rule.group), lambda m: F.length(m["part"]) >= rule.least)
    spans = F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(rule.kind).alias("kind")),
    )
    return F.when(text.rlike(_HINTS[rule.kind]), spans).otherwise(F.array().cast(_SPAN))


def entropy_hits(candidate: str, least: str) -> str:
    """SQL for the first and the last end of windows of a candidate with an entropy of ``least`` or more.

    One pass counts the entering character (``x.e``) in and the leaving one (``x.l``) out, and keeps
    the sum of c * log2(c) of the counts, from which a full window's entropy is log2(size) - sum / size.
    """
    codes = f"transform(split({candidate}, ''), c -> locate(c, '{ALPHABET}'))"
    # What the c-th equal character adds to the sum; of the counts, only those that change are replaced.
    step = f"transform(sequence(1, {WINDOW + 1}), c -> if(c > 1, c * log2(c) - (c - 1) * log2(greatest(c - 1, 1)), 0D))"
    size = len(ALPHABET)
    low, high, up = "least(x.l, x.e)", "greatest(x.l, x.e)", "if(x.e < x.l, 1, -1)"
    one = f"concat(slice(a.counts, 1, x.e - 1), array(a.counts[x.e - 1] + 1), slice(a.counts, x.e + 1, {size}))"
    both = f"""concat(slice(a.counts, 1, {low} - 1), array(a.counts[{low} - 1] + {up}),
        slice(a.counts, {low} + 1, {high} - {low} - 1), array(a.counts[{high} - 1] - {up}), slice(a.counts, {high} + 1, {size}))"""
    counts = f"case when x.l = x.e then a.counts when x.l = 0 then {one} else {both} end"
    total = "a.total - if(x.l > 0, steps[a.counts[greatest(x.l, 1) - 1] - 1], 0D) + steps[a.counts[x.e - 1] - if(x.l = x.e, 1, 0)]"
    hit = f"(a.at >= {WINDOW} and log2({WINDOW}) - a.total / {WINDOW} >= {least})"
    ends = f"'first', if({hit} and a.first = 0, a.at, a.first), 'last', if({hit}, a.at, a.last)"
    return f"""element_at(transform(array(named_struct('codes', {codes}, 'steps', {step})), y -> element_at(transform(array(y.steps), steps -> aggregate(
        transform(y.codes, (c, i) -> named_struct('e', c, 'l', if(i >= {WINDOW}, y.codes[greatest(i - {WINDOW}, 0)], 0), 'i', i + 1)),
        named_struct('counts', array_repeat(0, {size}), 'total', 0D, 'first', 0, 'last', 0, 'at', 0),
        (a, x) -> named_struct('counts', {counts}, 'total', {total}, {ends}, 'at', x.i),
        a -> named_struct({ends}))), 1)), 1)"""


def _suspicious(text: Column) -> Column:
    """Candidate strings that mix letters and digits."""
    found = F.filter(
        _places(text, _CANDIDATE, 0),
        lambda m: m["part"].rlike("[0-9]") & m["part"].rlike("[A-Za-z]"),
    )
    return F.when(text.rlike(_CANDIDATE), found).otherwise(F.array().cast("array<struct<start:int,end:int,part:string>>"))


def find_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secrets``: array of (start, kind_no, end, kind), sorted.

    Positions count code points, ends are exclusive. The base kinds are RULES' leftmost,
    non-overlapping matches. Beside them, kind ``entropy`` spans the windows of WINDOW characters
    whose Shannon entropy reaches the threshold of the candidate's character class, where no
    base span holds them all and the allow-list names nothing in them.

    Defined cases: a null or empty text has no secrets; repeated rows each get theirs; an empty
    table stays empty; very long texts are scanned whole; other columns pass through, and one
    named ``secrets`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(_base(text, k, rule) for k, rule in enumerate(RULES)))
    kept, found, hits = unused(docs, "base", "found", "hits")
    steps = docs.withColumns({kept: base, found: _suspicious(text)})
    least = "case " + " ".join(f"when m.part rlike '{p}' then {x}D" for p, x in CLASSES[:-1]) + f" else {CLASSES[-1][1]}D end"
    steps = steps.withColumn(
        hits, F.expr(f"""transform(`{found}`, m -> named_struct('at', m.start, 'part', m.part, 'hit', {entropy_hits("m.part", least)}))""")
    )
    spans = F.expr(f"""
        filter(
            transform(
                filter(`{hits}`, h -> h.hit.last > 0 and not (substr(h.part, h.hit.first - {WINDOW - 1}, h.hit.last - h.hit.first + {WINDOW}) rlike '{ALLOWED}')),
                h -> named_struct('start', h.at + h.hit.first - {WINDOW}, 'kind_no', {len(RULES)}, 'end', h.at + h.hit.last, 'kind', '{ENTROPY}')),
            e -> not exists(`{kept}`, b -> b.start <= e.start and e.end <= b.end))""")
    steps = steps.withColumn("secrets", F.array_sort(F.concat(F.col(kept), spans.cast(_SPAN))))
    return steps.drop(kept, found, hits)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def redact(found: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``find_secrets`` output with each secret in the text replaced by ``mark``; overlapping ones by one mark.

    What is left is cut between the furthest end so far and each secret that starts there or later,
    so that time grows with a text's length. A null text stays null; texts without secrets are unchanged.
    """
    # The text as UTF-32, from which a slice takes time in proportion to itself; a byte order mark before each is read and dropped.
    cut = "decode(concat(x'0000FEFF', substring(y.raw, 4 * {0} + 1, 4 * ({1} - {0}))), 'UTF-32')"
    reach = "greatest(y.tops[i], coalesce(array_max(slice(c.end, 1, j)), 0))"
    piece = f"if(s.start >= {reach}, concat({cut.format(reach, 's.start')}, {_quoted(mark)}), '')"
    done = F.expr(f"""element_at(transform(array(named_struct(
            'raw', encode(`{text_col}`, 'UTF-32'), 'end', array_max(secrets.end),
            'parts', transform(sequence(0, size(secrets) - 1, {_FOLD}), k -> slice(secrets, k + 1, {_FOLD})),
            'tops', transform(sequence(0, size(secrets) - 1, {_FOLD}), k -> coalesce(array_max(slice(secrets.end, 1, k)), 0)))),
        y -> concat(array_join(flatten(transform(y.parts, (c, i) -> transform(c, (s, j) -> {piece}))), ''), {cut.format('y.end', 'length(y.raw) div 4')})), 1)""")
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, done).otherwise(F.col(text_col)))

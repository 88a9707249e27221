"""Secret scan with multipart credential linking (operator 1, native).

Strong patterns (assignments of a secret word, access identifiers, long hex) are found in
every text with their code point spans. Weak candidates (identifiers such as ``user=``,
bare 40-character keys, endpoints) say little alone: they are reported only when parts that
complete a credential lie within ``SCOPE`` characters of them in the same document. Parts
are put into scope bins and interval-joined on (document row, bin).

A pattern's spans come from two regex results of equal matching: the matches and the gaps
between them (split); a running sum of both lengths per document gives the starts. Only
documents with a match get past the first, narrow table.

Reported weak kinds: ``weak_id`` with a secret part near; ``weak_secret`` with an identifier
or endpoint near; ``weak_endpoint`` with both an identifier and a secret near. A weak
candidate that overlaps a strong span is dropped, the strong one stays.

Defined cases: null text counts as empty; every input row gives a row (repeated rows repeat);
a null doc_id is kept as null; no match gives counts of 0 and the hash of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import written

SCOPE = 200

#: Strong kinds in report order: pattern, group whose length counts, its least length.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak kinds in report order.
WEAK = {
    "weak_id": (r"""(?i:\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 1, 3),
    "weak_secret": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "weak_endpoint": (r"""(?i:https?|ftps?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+""", 0, 8),
}
#: ``hex`` runs over every word otherwise: matches under the least length are common letters.
FAST = {"hex": r"[0-9a-f]{24,}"}
KINDS = [*STRONG, *WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}


def _matches(kind: str) -> Column:
    """The lengths of a kind's matches, of the gaps in front of them and of the counted group.

    For ``hex`` the failing matches are dropped inside the pattern: runs are maximal either
    way, so the same runs remain."""
    pattern, group, _ = (STRONG | WEAK)[kind]
    pattern = FAST.get(kind, pattern)
    text, p = F.coalesce(F.col("text"), F.lit("")), F.lit(pattern)
    size = lambda c: F.transform(c, lambda s: F.length(s))
    found = F.regexp_like(text, p)
    whole = size(F.regexp_extract_all(text, p, F.lit(0)))
    return F.when(found, F.struct(
        F.lit(kind).alias("kind"), size(F.split(text, pattern, -1)).alias("gap"), whole.alias("len"),
        (size(F.regexp_extract_all(text, p, F.lit(group))) if group else whole).alias("key")))


def scan_rows(docs: DataFrame) -> DataFrame:
    """Narrow table: row number, doc_id and the match lengths of each kind that occurs."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.array_compact(F.array(*[_matches(k) for k in KINDS])).alias("found"))


def candidate_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all matches that are long enough."""
    one = rows.select("row", F.explode("found").alias("f")).select(
        "row", F.col("f.kind").alias("kind"),
        F.posexplode(F.arrays_zip(F.slice("f.gap", F.lit(1), F.size("f.len")).alias("gap"), F.col("f.len").alias("len"), F.col("f.key").alias("key"))).alias("n", "m"))
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(before)
    least = F.create_map(*[F.lit(x) for k, (_, _, n) in (STRONG | WEAK).items() for x in (k, n)])
    return one.withColumn("end", end).where(F.col("m.key") >= least[F.col("kind")]).select(
        "row", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end")


def link_weak(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that complementary parts stand next to."""
    role = F.create_map(*[F.lit(x) for p in ROLE.items() for x in p])
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = spans.where(F.col("kind").isin(*WEAK)).select(
        "row", "kind", "start", "end", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"))
    parts = spans.select(
        F.col("row").alias("p_row"), F.col("kind").alias("p_kind"), role[F.col("kind")].alias("role"),
        F.col("start").alias("p_start"), F.col("end").alias("p_end"), bins(F.col("start"), F.col("end")).alias("p_bin"))
    near = weak.join(parts, (F.col("row") == F.col("p_row")) & (F.col("bin") == F.col("p_bin"))
                     & (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") + scope >= F.col("start")))
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    hidden = F.max((F.col("p_kind").isin(*STRONG) & (F.col("p_start") < F.col("end")) & (F.col("p_end") > F.col("start"))).cast("int"))
    linked = near.groupBy("row", "kind", "start", "end").agg(has("id").alias("i"), has("secret").alias("s"), has("endpoint").alias("e"), hidden.alias("h"))
    whole = (
        (F.col("kind") == "weak_id") & (F.col("s") == 1)
        | (F.col("kind") == "weak_secret") & ((F.col("i") == 1) | (F.col("e") == 1))
        | (F.col("kind") == "weak_endpoint") & (F.col("i") == 1) & (F.col("s") == 1)
    )
    return linked.where(whole & (F.col("h") == 0)).select("row", "kind", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, n_weak, ``base`` and ``spans``
    (arrays of kind, start, end in report order)."""
    rows = written(scan_rows(docs), "secret-rows")
    spans = written(candidate_spans(rows), "secret-spans")
    kept = spans.where(F.col("kind").isin(*STRONG)).unionByName(link_weak(spans, scope))
    place = F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)])
    each = F.struct(F.col("start"), place[F.col("kind")].alias("n"), F.col("kind"), F.col("end"))
    # bounded by the matches of one text
    per = kept.groupBy(F.col("row").alias("_r")).agg(F.array_sort(F.collect_list(each)).alias("spans"))
    out = rows.select("row", "doc_id").join(per, F.col("row") == F.col("_r"), "left")
    spans_ = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,n:int,kind:string,end:bigint>>"))
    out = out.withColumn("spans", spans_).withColumn("base", F.filter("spans", lambda x: x["n"] < len(STRONG)))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], (F.size("spans") - F.size("base")).cast("long").alias("n_weak"), "base", "spans")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

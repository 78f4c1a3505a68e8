"""Secret scan with multipart linking. Built-in functions only.

Base spans are single patterns. Weak candidates (long random-looking tokens, short access identifiers,
endpoints) are too common to report alone; an interval join of the parts within a scope of the text
reports a weak one only where its complementary parts stand near.

Spark gives the matches of a pattern and the pieces between them, but no positions: a span's end is the
running sum of piece and match lengths, a window over the document's hits (texts are not shuffled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Kinds in the order spans are listed: name, pattern, group and least length that a match must have.
BASE = [
    (
        "assign",
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # a run shorter than asked holds no longer match, so the length can stand in the pattern
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
WEAK = [
    ("weak_id", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{6,}", 0, 10),
    ("weak_secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}", 0, 24),
    ("endpoint", r"(?:https?|s3a?|ftps?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._~%:@-]+", 0, 8),
]
KINDS = BASE + WEAK
#: Parts of one credential start at most so many code points apart.
SCOPE = 300


def _hits(text: Column, number: int) -> Column:
    """Matches of one kind in order: kind, place, gap before, length, and whether it is long enough."""
    _, pattern, group, least = KINDS[number]
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(
        F.sequence(F.lit(1), F.size(whole)).alias("place"),
        F.transform(F.slice(pieces, 1, F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"),
        F.transform(tested, lambda m: F.length(m) >= least).alias("ok"),
    )
    found = F.transform(
        parts, lambda p: F.struct(F.lit(number).alias("kind"), p["place"].alias("place"), p["gap"].alias("gap"), p["len"].alias("len"), p["ok"].alias("ok"))
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(
        F.array().cast("array<struct<kind:int,place:int,gap:int,len:int,ok:boolean>>")
    )


def spans(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, stop), code points and end exclusive; a row without spans has nulls there.

    A weak identifier needs a secret (weak, assigned or hexadecimal) whose start is within the scope of
    its own, a weak secret an identifier, an endpoint both, the identifier having a secret itself. A
    part never counts as its own partner: partners don't overlap. An access span is not repeated as a weak one.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.concat(*[_hits(content, k) for k in range(len(KINDS))]).alias("_hits"),
    )
    hits = found.select("row", "doc_id", F.explode_outer("_hits").alias("_h")).select("row", "doc_id", "_h.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("stop") - F.col("len"))
    by_start = Window.partitionBy("row").orderBy("start")
    behind, ahead = by_start.rangeBetween(-scope, 0), by_start.rangeBetween(0, scope)
    names = [k[0] for k in KINDS]
    at = {name: names.index(name) for name in names}
    kind, ok = F.col("kind"), F.coalesce(F.col("ok"), F.lit(False))
    same_place = Window.partitionBy("row", "start")
    doubled = F.max((ok & (kind == at["access"])).cast("int")).over(same_place) == 1

    def beside(part: Column) -> Column:
        """Whether such a span within the scope ends before this one starts, or starts after it ends."""
        ends = F.min(F.when(part, F.col("stop"))).over(behind) <= F.col("start")
        starts = F.max(F.when(part, F.col("start"))).over(ahead) >= F.col("stop")
        return F.coalesce(ends, F.lit(False)) | F.coalesce(starts, F.lit(False))

    is_id = ok & kind.isin(at["access"], at["weak_id"])
    is_secret = ok & kind.isin(at["assign"], at["hex"], at["weak_secret"])
    marked = placed.withColumn("_doubled", doubled).withColumn("_id", beside(is_id)).withColumn("_secret", beside(is_secret))
    marked = marked.withColumn("_pair", beside(is_id & F.col("_secret")))
    reported = (
        F.when(kind < len(BASE), ok)
        .when(kind == at["weak_id"], ok & F.col("_secret") & ~F.col("_doubled"))
        .when(kind == at["weak_secret"], ok & F.col("_id"))
        .when(kind == at["endpoint"], ok & F.col("_pair") & F.col("_secret"))
        .otherwise(False)
    )
    none = F.lit(None)
    return marked.select(
        "row",
        "doc_id",
        F.when(reported, kind).otherwise(none).alias("kind"),
        F.when(reported, F.col("start")).otherwise(none).alias("start"),
        F.when(reported, F.col("stop")).otherwise(none).alias("stop"),
    )


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans. Repeated rows are scanned each for itself. Spans of different kinds
    may overlap. An empty table gives an empty result.
    """
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    every = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop"))))
    by_doc = spans(docs, scope, doc_id, text).groupBy("row").agg(F.first("doc_id").alias("doc_id"), every.alias("_all"))

    def joined(which: Column) -> Column:
        return F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])))

    def count(kind: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("_all", lambda s: s["kind"] < len(BASE))
    return by_doc.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    )

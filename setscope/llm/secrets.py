"""Secret scan with linking of credentials that come in parts. DataFrame functions only.

Three strong kinds of spans are always reported: assignments to secret names, access identifiers and long hexadecimal runs. Three weak
kinds are reported only where complementary parts occur together: an identifier with a secret, a secret with an identifier, an
endpoint with both. Together means within one scope: scopes are windows of a text that overlap by half, so parts closer than half a
scope share one. Parts and scopes meet by an interval join: a part lists the scopes that it overlaps, a scope knows which roles occur
in it, and both are joined by equality on text and scope. No pair of parts is formed, so a text with many parts costs a row for each.

Places are code points, ends exclusive. Null texts count as empty. A text is known by its id and a hash of it, compared with null equal
to null: rows repeated in full give repeated results, the same id with another text its own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import fields, same

#: Kinds in their order, the expression of each (letters of names in either case), the group whose length counts, and
#: the least length. A match that is too short is dropped after matching, so it still takes its place.
STRONG = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
WEAK = (
    ("key_id", r"""(?i:client_?id|account_?id|key_?id|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3),
    ("key_secret", r"[A-Za-z0-9+/]{40,}", 0, 40),
    ("endpoint", r"(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|ftp)://([A-Za-z0-9._:/@-]+)", 1, 4),
)
KINDS = [k for k, *_ in STRONG + WEAK]
#: What a kind is to its complements.
ROLES = {"assign": "secret", "hex": "secret", "access": "identifier", "key_id": "identifier", "key_secret": "secret", "endpoint": "endpoint"}
SCOPE = 512
KEY = ["doc_id", "text_hash"]


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind in order: what lies before each and how long it is. A text without a match is looked at once."""
    # These expressions match maximal runs, so asking for the least length in them finds the same matches as dropping short ones.
    quick = pattern.replace("[A-Z0-9]+", "[A-Z0-9]{16,}") if kind == "access" else pattern.replace("+", "{24,}") if kind == "hex" else pattern
    whole = F.regexp_extract_all(text, F.lit(quick), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(quick), F.lit(group)) if group else whole
    rows = F.transform(
        F.arrays_zip(F.split(text, quick, -1).alias("gap"), whole.alias("whole"), counted.alias("counted")),
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("place"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("length"),
            (F.length(m["counted"]) >= least).alias("kept"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,length:int,kept:boolean>>")
    # The piece after the last match has no match.
    return F.when(F.regexp_like(text, F.lit(quick)), F.filter(rows, lambda m: m["length"].isNotNull())).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, kind, start, end)`` of every part, strong or weak; one pass over the texts, a shuffle of the parts only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = fields(docs, doc_id="bigint", text="string").select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.flatten(F.array(*[_found(text, *kind) for kind in STRONG + WEAK])).alias("found"),
    )
    found = found.filter(F.size("found") > 0).select(*KEY, F.inline("found"))
    # Rows repeated in full would interleave their matches.
    found = found.distinct()
    before = Window.partitionBy(*KEY, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    return found.withColumn("end", end).filter("kept").select(*KEY, "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def scoped(found: DataFrame) -> DataFrame:
    """Each part once for every scope that it overlaps."""
    half = SCOPE // 2
    # Scope s covers [s * half, s * half + SCOPE).
    first = F.greatest(F.expr(f"start div {half} - 1"), F.lit(0))
    return found.withColumn("scope", F.explode(F.sequence(first, F.expr(f"(end - 1) div {half}"))))


def linked(found: DataFrame) -> DataFrame:
    """The parts that are reported: all strong ones, and weak ones with their complements in a scope."""
    strong = F.col("kind") < len(STRONG)
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])])[F.col("kind")]
    by_scope = scoped(found).withColumn("role", role)
    met = by_scope.groupBy(*KEY, "scope").agg(
        F.max(F.col("role") == "identifier").alias("identifier"), F.max(F.col("role") == "secret").alias("secret")
    )
    # A scope without both complements proves nothing, so it never enters the join.
    met = met.filter("identifier and secret")
    weak = by_scope.filter(~strong)
    proven = weak.join(met, same(weak, met, [*KEY, "scope"]), "left_semi").select(*KEY, "kind", "start", "end").distinct()
    return found.filter(strong).unionByName(proven)


def links(found: DataFrame) -> DataFrame:
    """Credentials put together, one row for each scope with both complements: its first identifier, secret and endpoint."""
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])])[F.col("kind")]
    by_scope = scoped(found).withColumn("role", role)
    first = [
        F.min(F.when(F.col("role") == r, F.struct("start", "end", "kind"))).alias(r) for r in ("identifier", "secret", "endpoint")
    ]
    return by_scope.groupBy(*KEY, "scope").agg(*first).filter("identifier is not null and secret is not null").drop("scope").distinct()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans)`` of the texts with spans; spans by start, then kind: ``array<struct<start,kind,end>>``."""
    found = linked(materialise(parts(docs), "secret-parts"))
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def secret_summary(docs: DataFrame) -> DataFrame:
    """Per document: counts of the strong kinds, a digest of their spans, and all spans as text."""
    rows = fields(docs, doc_id="bigint", text="string").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    spans = scan_secrets(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    strong = F.filter("spans", lambda s: s["kind"] < len(STRONG))
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))), F.lit(0)).cast("bigint")
    joined = rows.join(spans, same(rows, spans, KEY), "left").select(
        rows["doc_id"], F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans")
    )
    return joined.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in STRONG],
        F.sha2(F.array_join(F.transform(strong, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def redact(docs: DataFrame, placeholder: str = "[SECRET]", size_column: str | None = None) -> DataFrame:
    """``docs`` with all their columns, every reported span of ``text`` replaced; touching spans give one placeholder. A column named
    ``size_column`` gets the new length of texts that changed.

    The table travels as one struct beside names of this function, so its columns may have any names and come back unchanged; a table
    without spans keeps its texts, null ones too.
    """
    # Each span with the furthest end before it; both give the text in between.
    earlier = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = scan_secrets(docs).select(*KEY, F.explode("spans").alias("s")).select(*KEY, "s.start", "s.end")
    each = each.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("bigint")))
    spans = each.groupBy(*[F.col(k).alias(f"of_{k}") for k in KEY]).agg(F.sort_array(F.collect_list(F.struct("start", "end", "before"))).alias("spans"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    on = F.col("of_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of_text_hash") == F.col("text_hash"))
    joined = rows.join(spans, on, "left")
    gaps = F.transform(
        "spans",
        lambda x, i: F.when(
            (x["start"] > x["before"]) | (i == 0), F.concat(F.substring("text", x["before"] + 1, F.greatest(x["start"] - x["before"], F.lit(0))), F.lit(placeholder))
        ).otherwise(""),
    )
    # All pieces are joined at once, so the work does not grow with the square of the spans.
    until = F.array_max(F.transform("spans", lambda x: x["end"]))
    clean = F.concat(F.array_join(gaps, ""), F.substring("text", until + 1, F.length("text")))
    done = joined.withColumn("clean", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(clean))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == size_column:
            old = F.when(F.col("spans").isNull(), old).otherwise(F.length("clean").cast(docs.schema[name].dataType))
        return (F.col("clean") if name == "text" else old).alias(name)

    return done.select(*[column(c) for c in docs.columns])


def _either_case(pattern: str) -> str:
    """Spells out the names of a pattern in either case, for an engine that folds letters beyond ASCII, too."""
    if not pattern.startswith("(?i:"):
        return pattern
    names, rest = pattern[4:].split(")", 1)
    # The classes of ``jdbc:[a-z]+`` stand for both cases as well.
    names = names.replace("[a-z]", "[a-zA-Z]")
    spelled, inside = "", False
    for c in names:
        inside = c == "[" or inside and c != "]"
        spelled += f"[{c}{c.upper()}]" if c.isalpha() and not inside else c
    return f"(?:{spelled}){rest}"


def oracle() -> str:
    """SQL for ``secret_summary`` over the table ``documents``."""
    found = []
    for i, (_, pattern, group, least) in enumerate(STRONG + WEAK):
        p = "'" + _either_case(pattern).replace("'", "''") + "'"
        found.append(
            f"SELECT r, {i} AS kind, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS w, "
            f"regexp_extract_all(t, {p}, {group}) AS v, {least} AS least FROM d WHERE regexp_matches(t, {p})"
        )
    role = " ".join(f"WHEN {i} THEN '{ROLES[k]}'" for i, k in enumerate(KINDS))
    name = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    half = SCOPE // 2
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(found)}),
p AS (
  SELECT r, kind, len(w[k]) AS n, len(v[k]) >= least AS kept,
    list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: len(x))), 0) AS a
  FROM m, unnest(range(1, len(w) + 1)) AS t(k)),
parts AS (SELECT r, kind, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS z, CASE kind {role} END AS role FROM p WHERE kept),
scoped AS (SELECT *, unnest(range(greatest(a // {half} - 1, 0), (z - 1) // {half} + 1)) AS s FROM parts),
met AS (SELECT r, s FROM scoped GROUP BY r, s HAVING bool_or(role = 'identifier') AND bool_or(role = 'secret')),
said AS (
  SELECT r, kind, a, z FROM parts WHERE kind < {len(STRONG)}
  UNION ALL SELECT DISTINCT r, kind, a, z FROM scoped SEMI JOIN met USING (r, s) WHERE kind >= {len(STRONG)}),
texts AS (SELECT *, CASE kind {name} END || ':' || a || ':' || z AS shown FROM said),
sums AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY a, kind) FILTER (kind < {len(STRONG)}) AS base, string_agg(shown, ',' ORDER BY a, kind) AS spans
  FROM texts GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums ON d.r = sums.r
"""

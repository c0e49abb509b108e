"""Merkle manifest of a table: a tree of SHA-256 digests for each group of rows, one over the groups' roots, and each row's proof.

A level of a tree is a table of nodes with their place in the group. Siblings come from windows: of a run of ``fan`` nodes each has lag and lead columns of
fixed offsets, masked by its slot and the run's length, and the row in the first slot hashes the parent. A window covers ``BLOCK`` places, which is a
multiple of ``fan``, so a group that holds most rows is as many windows as it has blocks. Places are not counted by one window either: rows are put in order by a
range exchange, and a row's place is its place in its partition plus the rows of its group in those before.

Levels shrink by ``fan`` and are written; going down again, a node's path is its own siblings and its parent's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .work import drop, read_table, row_count, shuffle_count, small, stored

FAN = 8
BLOCK = FAN**3
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(c: Column) -> Column:
    """A value with its length in front, so that fields can't run into each other; null is ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def group_key(c: Column) -> Column:
    """Text that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (key, ..) with ``pos``, their place from 0 among those of their key in the order of ``by``, and ``n``, the number of those.

    Rows that are equal in ``by`` are told apart by a salt, so that many of them are still split over partitions; which comes first doesn't matter to a tree if
    ``by`` includes the digest.
    """
    salted = stored(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    order = ["key", *by, "salt"]
    sorted_ = salted.repartitionByRange(shuffle_count(rows.sparkSession), *order).sortWithinPartitions(*order)
    numbered = stored(sorted_.drop("salt").withColumn("at", F.monotonically_increasing_id()), "ordered-leaves")
    drop(salted)
    part = F.shiftright("at", 33)
    spans = numbered.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("key")  # a row for each partition that has the key
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "spans")
    widest = spans.agg(F.max(F.octet_length("key"))).first()[0] or 0
    return numbered.withColumn("part", part).join(small(spans, extra=widest), ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, pos, n, h, ..) with the digests of the run's others, those to the left and those to the right, each as one text."""
    run = Window.partitionBy("key", F.expr(f"pos div {BLOCK}")).orderBy("pos")
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("n") - F.col("pos") + slot)
    left = [F.when(slot >= j, F.lag("h", j).over(run)) for j in range(FAN - 1, 0, -1)]
    right = [F.when(slot + j < length, F.lead("h", j).over(run)) for j in range(1, FAN)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all keys' trees, from placed leaves up; the last node of a key has n = 1. Stored tables of nodes with their siblings."""
    levels: list[DataFrame] = []
    nodes = leaves
    while True:
        level = stored(with_siblings(nodes), f"level-{len(levels)}")
        if levels and not row_count(level):
            drop(level)
            return levels
        levels.append(level)
        first = level.filter((F.col("n") > 1) & (F.col("pos") % FAN == 0))
        nodes = first.select("key", F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.concat("h", "right"), 256).alias("h"))


def ends(levels: list[DataFrame]) -> DataFrame:
    """(key, h): the root of each key."""
    tops = [level.filter("n = 1").select("key", "h") for level in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``: the siblings of each of their ancestors, from their own up, then the path that ``above`` (key, path, ..) has for their key."""
    carried = [c for c in above.columns if c != "key"]
    found: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        tops = level.filter("n = 1").join(above, "key")
        if found is not None:
            # at most (FAN - 1) digests a level, and the numbers
            width = 100 + 64 * FAN * (len(levels) - k + 8)
            up = found.select("key", F.col("pos").alias("up"), *carried)
            up = F.broadcast(up) if row_count(levels[k + 1]) * width <= 4 << 20 else up.hint("merge")
            joined = level.filter("n > 1").withColumn("up", F.expr(f"pos div {FAN}")).join(up, ["key", "up"]).drop("up")
            tops = tops.unionByName(joined.withColumn("path", F.concat(F.array(F.struct("left", "right")), F.col("path"))))
        found = tops
    return found


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def merkle_manifest(leaves: DataFrame, *by: str) -> tuple[DataFrame, str | None]:
    """(leaves with ``path`` and ``subroot``, root) for ``leaves`` (key, h, ..), h being a row's digest; within a key they stand in the order of ``by``, then of h.

    Every run of 8 nodes becomes their digest, the last one with fewer, even one; a key with one leaf has that for its subroot. The subroots in order of their
    keys are the leaves of one more tree. Equal rows are leaves of their own. An empty table has no root.
    """
    levels = tree(placed(leaves, *by, "h"))
    subroots = stored(ends(levels), "subroots")
    if not row_count(subroots):
        return levels[0].select(*leaves.columns, F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")), None
    upper = tree(placed(subroots.select(F.lit("").alias("key"), "h", F.col("key").alias("group")), "group"))
    root = ends(upper).first()["h"]
    top = upper[0].sparkSession.createDataFrame([("",)], "key string").withColumn("path", F.array().cast(PATH))
    of_group = stored(with_paths(upper, top).select(F.col("group").alias("key"), "path", F.col("h").alias("subroot")), "group-paths")  # every level reads it
    return with_paths(levels, of_group).select(*leaves.columns, "path", "subroot"), root


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null fields have a mark of their own; rows without id come first and are not tampered with; repeated rows are leaves of their own; an empty table gives no
    rows; other columns are ignored."""
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = leaf_digest(*fields[:4], F.translate("text", UPPER, LOWER))
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(group_key(F.col("lang")).alias("key"), "doc_id", leaf_digest(*fields).alias("h"), F.when(picked, changed).alias("changed"))
    proofs, root = merkle_manifest(leaves, "doc_id")
    whole = F.lit(root).cast("string")
    out = proofs.select("doc_id", F.col("h").alias("leaf"), "subroot", whole.alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), fold(F.col("path"), F.coalesce("changed", "h")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = {
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, coalesce('1' || lang, '0') AS key,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4]))),
      lambda a, x: xor(([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(a, x) & 15) + 1], a >> 4)) AS c FROM documents),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, xor(c, 4294967295::BIGINT) % 3 = 0 AS picked FROM d),
leaves AS (SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, CASE WHEN picked THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
nodes AS (SELECT key, 0 AS level, pos, n, h FROM l
  UNION ALL SELECT key, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY key, level, pos // 8, n),
subs AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, h FROM subs
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT key, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, level, pos // 8, list(h ORDER BY pos) FROM tops WHERE n > 1 GROUP BY level, pos // 8),
steps AS (SELECT l.key, l.pos AS leaf_pos, 0 AS part, r.level, r.hs, (l.pos // (8 ** r.level)::BIGINT) % 8 AS slot FROM l JOIN runs r ON r.key = l.key AND r.run = l.pos // (8 ** (r.level + 1))::BIGINT
  UNION ALL SELECT l.key, l.pos, 1, r.level, r.hs, (s.pos // (8 ** r.level)::BIGINT) % 8 FROM l JOIN subs s ON s.key = l.key JOIN runs r ON r.key IS NULL AND r.run = s.pos // (8 ** (r.level + 1))::BIGINT),
path AS (SELECT key, leaf_pos, list({'l': array_to_string(hs[:slot], ''), 'r': array_to_string(hs[slot + 2:], '')} ORDER BY part, level) AS p FROM steps GROUP BY key, leaf_pos),
up AS (SELECT l.key, l.pos, coalesce(changed, h) AS h, 1 AS i, coalesce(p, []) AS p FROM l LEFT JOIN path ON path.key = l.key AND leaf_pos = l.pos
  UNION ALL SELECT key, pos, sha256(p[i].l || h || p[i].r), i + 1, p FROM up WHERE i <= len(p)),
done AS (SELECT key, pos, h AS folded, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof FROM up WHERE i > len(p))
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, d.proof AS proof_sha256, d.folded AS folded_root, d.folded = t.h AS verified
FROM l JOIN subs s ON s.key = l.key JOIN (SELECT h FROM tops WHERE n = 1) t ON true JOIN done d ON d.key = l.key AND d.pos = l.pos"""
}

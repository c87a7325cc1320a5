"""Operator 11: a Merkle manifest of a table, its proofs and their check.

Bottom-up build: the leaves of a group are numbered by ranges (``number_rows``),
and every ``fanout`` consecutive nodes become one.  ``STRIDE_NODES`` nodes make a
block, a row of the persisted table of that tier; it holds the levels between its nodes
and the one node that stands for it in the next tier.  A billion leaves thus
take three tiers, and no row holds more than a block.

Top-down proof push: the blocks of a tier join the proofs of the tier above by block
number.  A child's proof is its own siblings inside the block, before the
suffix that its block inherits.  The groups' roots are the leaves of one
more tree of the same kind.

Digests are lowercase hex throughout and enter further hashes as that text.
All of it is built-in functions; hashing, levels and folds run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, q, table, tune
from quarryline.operators.numbering import number_rows
from quarryline.session import saved

#: Nodes of a block, at most: bounds the rows of the persisted tables.
STRIDE_NODES = 1024
_STEP = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (so that no two rows read alike)."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*(field_text(v) for v in values)))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def siblings_text(proof: Column) -> Column:
    """All sibling digests of a proof, from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _stride(fanout: int) -> int:
    """Levels of a block."""
    n = 1
    while fanout ** (n + 1) <= STRIDE_NODES:
        n += 1
    return n


def _levels_above(fanout: int, stride: int, n: Column) -> Column:
    """Levels that ``n`` nodes of a group go up inside one tier."""
    return F.size(F.filter(F.array(*(F.lit(fanout**i) for i in range(stride))), lambda width: width < n))


def _levels(kids: Column, height: Column, fanout: int) -> Column:
    """Digests of every level over ``kids``: those of the kids first, one node last (if ``height`` is enough)."""

    def up(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(fanout)).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))

    own = F.array(F.transform(kids, lambda k: k["digest"]))
    rounds = F.when(height > 0, F.sequence(F.lit(1), F.greatest(height, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, own, lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


@dataclass
class Manifest:
    """The persisted trees: of each group, and of the groups' roots.

    Tables of a tier: grp, block, n, height, kids (digest and, at the leaves, id and what was carried along), levels, digest.
    """

    spark: SparkSession
    fanout: int
    tiers: list[DataFrame] = field(default_factory=list)
    top: list[DataFrame] = field(default_factory=list)

    def root(self) -> str | None:
        """The digest of the whole table; None if it has no rows."""
        row = self.top[-1].select("digest").first() if self.top else None
        return row["digest"] if row else None

    def proofs(self) -> DataFrame:
        """A row for each leaf: what was carried along, digest, subroot, root, proof (``before`` and ``after`` of each level)."""
        above = _push(self.top, None, self.fanout)
        groups = above.select(F.col("kid.name").alias("grp"), F.lit(0).cast("long").alias("pos"), "proof", "root", F.col("kid.digest").alias("subroot"))
        return _push(self.tiers, groups, self.fanout)


def _tree(nodes: DataFrame, fanout: int, keep: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Tiers over ``nodes`` (grp, pos, n, kid), up to one block a group."""
    stride = _stride(fanout)
    width, tiers = fanout**stride, []
    while True:
        block = F.floor(F.col("pos") / F.lit(width)).cast("long")
        rows = nodes.groupBy("grp", block.alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "kid"))).alias("kids"))
        rows = rows.select("grp", "block", "n", _levels_above(fanout, stride, F.col("n")).alias("height"), F.transform("kids", lambda k: k["kid"]).alias("kids"))
        rows = rows.withColumn("levels", _levels(F.col("kids"), F.col("height"), fanout))
        tiers.append(keep(rows.withColumn("digest", F.element_at(F.element_at("levels", -1), 1))))
        if not (tiers[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > width:
            return tiers
        nodes = tiers[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(width)).cast("long").alias("n"), F.struct("digest").alias("kid"))


def _push(tiers: list[DataFrame], above: DataFrame | None, fanout: int) -> DataFrame:
    """Proofs from the top tier down to the nodes of the first: grp, pos, kid, proof, root, subroot."""
    for i, tier in reversed(list(enumerate(tiers))):
        tier = tier.withColumnRenamed("block", "pos").drop("n")
        if above is None:
            rows = tier.withColumns({"proof": F.array().cast(_STEP), "root": F.col("digest"), "subroot": F.col("digest")})
        else:
            rows = tier.join(above.select("grp", "pos", "proof", "root", "subroot"), ["grp", "pos"])

        def step(at: Column, level: Column) -> Column:
            nodes, place = F.element_at(F.col("levels"), level + 1), F.floor(at / F.pow(F.lit(fanout), level)).cast("int")
            run = F.slice(nodes, place - place % fanout + 1, F.lit(fanout))
            return F.struct(F.array_join(F.slice(run, F.lit(1), place % fanout), "").alias("before"), F.array_join(F.slice(run, place % fanout + 2, F.lit(fanout)), "").alias("after"))

        heights = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.greatest(F.col("height"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

        def child(kid: Column, at: Column) -> Column:
            own = F.transform(heights, lambda level: step(at, level))
            base = F.col("pos") * F.lit(fanout ** _stride(fanout))
            return F.struct((base + at).alias("pos"), kid.alias("kid"), F.concat(own, F.col("proof")).alias("proof"))

        above = rows.select("grp", "root", "subroot", F.inline(F.transform("kids", child)))
    return above


def build(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, carry: dict[str, Column] | None = None, keep: Callable[[DataFrame], DataFrame] = saved) -> Manifest:
    """The manifest of ``docs``: a leaf is the digest of ``columns``, in this order; a tree for each value of ``group_col``.

    ``carry`` names further values that come out beside a leaf's proof.  ``keep`` writes the manifest's tables and reads them back; by default
    they go with the session.

    Nulls: a null value is a leaf's ``-``; a null group is a group of its own, before the others, and a null id stands before the other ids.
    Empty text is a value of length 0, so it differs from null; texts of any length are hashed whole, inside the JVM.
    Ties: rows of one id stand by their leaf, so repeated rows are neighbours and each has its own proof.
    An empty table has no root and no proofs.  Other columns are ignored; names that occur here (``grp``, ``pos``, ``digest``...)
    may be names of the input.
    """
    if fanout < 2 or fanout > STRIDE_NODES:
        raise ValueError(f"fanout must be from 2 to {STRIDE_NODES}")
    spark = docs.sparkSession
    tune(spark)
    carry = carry or {}
    name = F.col(q(group_col)).cast("string")
    kid = F.struct(leaf_digest(*(F.col(q(c)) for c in columns)).alias("digest"), F.col(q(id_col)).alias("id"), *(v.alias(k) for k, v in carry.items()))
    with Scratch(spark) as scratch:
        leaves = scratch.table(docs.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("grp"), F.col(q(id_col)).alias("id"), kid.alias("kid")))
        placed = number_rows(leaves, ["id", F.col("kid.digest")], "grp", keep=scratch.table)
        tiers = _tree(placed.select("grp", "pos", "n", "kid"), fanout, keep)
    roots = tiers[-1].filter("block = 0").select("grp", F.struct("digest", F.col("grp").alias("name")).alias("kid"))
    with Scratch(spark) as scratch:
        placed = number_rows(scratch.table(roots), ["grp"], keep=scratch.table)
        top = _tree(placed.select(F.lit("").alias("grp"), "pos", "n", "kid"), fanout, keep)
    return Manifest(spark, fanout, tiers, top)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and n_levels) of every row, where each seventh id's ``n_chars`` was tampered with.

    Nulls, empty and long texts, repeated rows and an empty table as in ``build``; a null id is never tampered with.
    """
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    made = build(docs, COLUMNS, carry={"found": F.when(hit, leaf_digest(*changed))}).proofs()
    rows = made.select(F.col("kid.id").alias("doc_id"), F.col("kid.digest").alias("leaf"), "subroot", "root", digest(siblings_text(F.col("proof"))).alias("proof_sha256"), fold(F.coalesce("kid.found", "kid.digest"), F.col("proof")).alias("folded_root"), F.size("proof").cast("long").alias("n_levels"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "n_levels")


#: Unsigned crc32 of the ASCII bytes of ``{text}``, bit by bit.
CRC32 = "(xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split({text}, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for _ in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1) + 0 * y))), 4294967295))"

_FIELD = "coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(v=n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


SQL_OP11 = f"""
WITH RECURSIVE d AS (SELECT *, {_leaf_sql("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS found FROM documents),
p AS (SELECT doc_id, leaf, coalesce(found, leaf) AS found, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT g, 0 AS lev, pos, n, leaf AS h FROM p UNION ALL
 SELECT g, lev + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS nxt FROM t WHERE n > 1) WHERE pos % 2 = 0),
s AS (SELECT g, h, lev AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, pos, n, h FROM s UNION ALL
 SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS nxt FROM u WHERE n > 1) WHERE pos % 2 = 0),
k AS (SELECT p.doc_id, p.leaf, p.g, p.pos, l.lev, (p.pos >> l.lev) % 2 AS odd, coalesce(x.h, '') AS sib FROM p JOIN s ON p.g = s.g JOIN (SELECT unnest(range(0, 64)) AS lev) l ON l.lev < s.height LEFT JOIN t x ON x.g = p.g AND x.lev = l.lev AND x.pos = xor(p.pos >> l.lev, 1)
 UNION ALL SELECT p.doc_id, p.leaf, p.g, p.pos, s.height + l.lev, (s.pos >> l.lev) % 2, coalesce(x.h, '') FROM p JOIN s ON p.g = s.g JOIN (SELECT unnest(range(0, 64)) AS lev) l ON l.lev < (SELECT max(lev) FROM u) LEFT JOIN u x ON x.lev = l.lev AND x.pos = xor(s.pos >> l.lev, 1)),
f AS (SELECT p.g, p.pos, p.doc_id, p.leaf, 0 AS lev, p.found AS h FROM p UNION ALL SELECT f.g, f.pos, f.doc_id, f.leaf, f.lev + 1, sha256(CASE WHEN k.odd = 1 THEN k.sib || f.h ELSE f.h || k.sib END) FROM f JOIN k ON f.g = k.g AND f.pos = k.pos AND f.lev = k.lev),
e AS (SELECT g, pos, arg_max(h, lev) AS folded, max(lev) AS n_levels FROM f GROUP BY g, pos),
c AS (SELECT g, pos, sha256(string_agg(sib, '' ORDER BY lev)) AS proof_sha256 FROM k GROUP BY g, pos),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.root, coalesce(c.proof_sha256, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified, e.n_levels::BIGINT AS n_levels
FROM p JOIN s ON p.g = s.g JOIN e ON e.g = p.g AND e.pos = p.pos LEFT JOIN c ON c.g = p.g AND c.pos = p.pos, r
"""

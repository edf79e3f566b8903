"""Rule trees held as variants: walks by recursive SQL, and lists of what hangs on the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that a walk follows at most; a deeper tree raises.
DEPTH = 24


def walk(trees: DataFrame, id_column: str, tree: str, children: str = "children", depth: int = DEPTH) -> DataFrame:
    """A row for each node of each tree (JSON text): id, path (positions from the root), depth and node (variant)."""
    return trees.sparkSession.sql(f"""
        WITH RECURSIVE walk(id, path, depth, node) MAX RECURSION LEVEL {depth} AS (
            SELECT id, '' AS path, 0 AS depth, node FROM {{trees}}
            UNION ALL
            SELECT w.id, w.path || '/' || c.pos, w.depth + 1, c.value
            FROM walk w, LATERAL variant_explode(variant_get(w.node, '$.{children}', 'variant')) c
        )
        SELECT * FROM walk""", trees=trees.select(F.col(id_column).alias("id"), F.parse_json(tree).alias("node")))


def leaves(walked: DataFrame, children: str = "children") -> DataFrame:
    """Nodes without children."""
    return walked.filter(F.variant_get("node", f"$.{children}", "variant").isNull())


def level_limits(text: F.Column) -> F.Column:
    """A rule's limit by level: array of (kind: at_least or at_most, units, level, and_higher)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("(at (?:least|most) [0-9]+ units at level [0-9](?: or higher)?)"), 1)
    pick = lambda x, p: F.regexp_extract(x, p, 1)
    return F.transform(parts, lambda x: F.struct(
        F.replace(pick(x, "^(at (?:least|most))"), F.lit(" "), F.lit("_")).alias("kind"), pick(x, "([0-9]+) units").cast("int").alias("units"),
        pick(x, "level ([0-9])").cast("int").alias("level"), F.contains(x, F.lit("or higher")).alias("and_higher")))

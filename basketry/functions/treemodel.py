"""Gradient-boosted tree models as Catalyst expressions.

A model is a list of trees, each given by its node arrays (split feature, threshold, children, leaf
values) in the common text format of gradient-boosting libraries. ``tree_score`` compiles them into
one nested ``CASE WHEN`` expression, so scoring runs inside whole-stage codegen with no Python per
row. Numeric splits: ``value <= threshold`` goes left; a NULL/NaN value counts as 0.0 (the saved
model's splits have no missing-value handling and default to the left branch only through that).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Tree:
    split_feature: list[int]
    threshold: list[float]
    left_child: list[int]
    right_child: list[int]
    leaf_value: list[float]
    split_gain: list[float] = field(default_factory=list)


@dataclass
class TreeModel:
    feature_names: list[str]
    trees: list[Tree]

    @property
    def getNumTrees(self) -> int:
        """The name that Spark ML ensembles use."""
        return len(self.trees)


# ---------------------------------------------------------------------------------------------
# The saved purchase ranker (1 tree, 26 leaves, 5 features).
# ---------------------------------------------------------------------------------------------
SAVED_RANKER = TreeModel(
    feature_names=["purchase_count", "recency", "purchase_frequency_encoded", "popularity_rank", "sales_count"],
    trees=[Tree(
        split_feature=[3, 3, 4, 4, 0, 1, 3, 3, 0, 4, 4, 3, 4, 4, 3, 0, 4, 4, 3, 3, 3, 1, 4, 3, 4],
        threshold=[999.50000000000011, 292.50000000000006, 203.50000000000003, 77.500000000000014,
                   2.5000000000000004, 9.5000000000000018, 13.500000000000002, 284.50000000000006,
                   2.5000000000000004, 694.00000000000011, 511.00000000000006, 18.500000000000004,
                   409.50000000000006, 394.00000000000006, 27.500000000000004, 2.5000000000000004,
                   367.00000000000006, 202.50000000000003, 482.50000000000006, 510.50000000000006,
                   515.50000000000011, 16.500000000000004, 60.500000000000007, 140.50000000000003,
                   248.50000000000003],
        left_child=[1, 2, 7, -3, -5, 6, -4, 8, -1, 10, 11, -7, 13, 14, -13, -8, 23, -10, 21, -20, -21, -6, -2,
                    24, -16],
        right_child=[22, 3, 5, 4, 18, 9, 15, -9, 17, -11, -12, 12, -14, -15, 16, -17, -18, -19, 19, 20, -22, -23,
                     -24, -25, -26],
        leaf_value=[-0.01011077621804419, 0.02, -0.013261319137905705, 0.0066946796617618921,
                    -0.012488649505281091, -0.0075766526487077148, -0.013476601786891189,
                    -0.0054223688992543527, -4.8051622617056007e-05, -0.0059937562040614425,
                    -0.016722037874741313, 0.0034208138762016915, 0.011725619738169067, 0.0063475983922827743,
                    -0.018275910639241749, -0.0052890125033028161, 0.0004461891167233931,
                    -0.012489498694305868, -0.019013034125833331, -0.013873219019554562, 0.0012126199972984121,
                    -0.0097443931891073744, -0.01006295073675958, 0.011316084950859709, 0.010463831530868328,
                    -0.001790759603624638],
        split_gain=[8651.2, 430.846, 80.7105, 61.2802, 25.0068, 22.1646, 17.0797, 15.949, 13.0728, 11.432, 13.314,
                    11.8224, 12.0379, 18.7004, 16.483, 9.56985, 9.22858, 9.12534, 7.80527, 12.593, 17.4741, 7.15272,
                    7.04836, 6.7674, 8.12354],
    )],
)


def parse_model_text(text: str) -> TreeModel:
    """Read the ``key=value`` text format (``feature_names=...``, then ``Tree=i`` blocks)."""
    names: list[str] = []
    trees: list[Tree] = []
    cur: dict[str, str] | None = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("feature_names=") and not names:
            names = line.split("=", 1)[1].split()
        elif line.startswith("Tree="):
            if cur:
                trees.append(_tree(cur))
            cur = {}
        elif line.startswith("end of trees"):
            break
        elif cur is not None and "=" in line:
            k, v = line.split("=", 1)
            cur[k] = v
    if cur:
        trees.append(_tree(cur))
    return TreeModel(names, trees)


def _tree(d: dict[str, str]) -> Tree:
    ints = lambda k: [int(x) for x in d.get(k, "").split()]
    floats = lambda k: [float(x) for x in d.get(k, "").split()]
    if "split_feature" not in d:  # a single-leaf tree
        return Tree([], [], [], [], floats("leaf_value"))
    return Tree(ints("split_feature"), floats("threshold"), ints("left_child"), ints("right_child"),
                floats("leaf_value"), floats("split_gain"))


def feature_value(c: Column) -> Column:
    x = c.cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def tree_expr(tree: Tree, features: list[Column]) -> Column:
    """The tree as nested ``when``: depth of the expression = depth of the tree."""
    if not tree.split_feature:
        return F.lit(float(tree.leaf_value[0]))

    def node(i: int) -> Column:
        if i < 0:
            return F.lit(float(tree.leaf_value[~i]))
        cond = features[tree.split_feature[i]] <= F.lit(float(tree.threshold[i]))
        return F.when(cond, node(tree.left_child[i])).otherwise(node(tree.right_child[i]))

    return node(0)


def tree_score(model: TreeModel, columns: list[str | Column] | None = None) -> Column:
    """Sum of leaf values over all trees for the feature columns (default: the model's names)."""
    cols = columns or model.feature_names
    feats = [feature_value(F.col(c) if isinstance(c, str) else c) for c in cols]
    total = None
    for t in model.trees:
        e = tree_expr(t, feats)
        total = e if total is None else total + e
    return total if total is not None else F.lit(0.0)


def model_text(model: TreeModel) -> str:
    """Write a model in the same ``key=value`` text format that ``parse_model_text`` reads."""
    lines = ["tree", "feature_names=" + " ".join(model.feature_names), ""]
    for i, t in enumerate(model.trees):
        lines += [f"Tree={i}", f"num_leaves={len(t.leaf_value)}"]
        if t.split_feature:
            lines += ["split_feature=" + " ".join(map(str, t.split_feature)),
                      "threshold=" + " ".join(repr(float(x)) for x in t.threshold),
                      "left_child=" + " ".join(map(str, t.left_child)),
                      "right_child=" + " ".join(map(str, t.right_child))]
            if t.split_gain:
                lines.append("split_gain=" + " ".join(repr(float(x)) for x in t.split_gain))
        lines += ["leaf_value=" + " ".join(repr(float(x)) for x in t.leaf_value), ""]
    lines.append("end of trees")
    return "\n".join(lines) + "\n"


def nodes_sql_values(model: TreeModel) -> tuple[str, str]:
    """(nodes, leaves) as SQL VALUES lists for an independent recursive-CTE scorer."""
    nodes, leaves = [], []
    for ti, t in enumerate(model.trees):
        for i in range(len(t.split_feature)):
            nodes.append(f"({ti}, {i}, {t.split_feature[i]}, {float(t.threshold[i])!r}, {t.left_child[i]}, "
                         f"{t.right_child[i]})")
        for i, v in enumerate(t.leaf_value):
            leaves.append(f"({ti}, {i}, {float(v)!r})")
    return ", ".join(nodes), ", ".join(leaves)


NODES = "tree int, node int, feature string, threshold double, left_child int, right_child int, gain double, value double"


def model_nodes(spark: SparkSession, model: TreeModel) -> DataFrame:
    """A model as a table of nodes: inner nodes from 0 with feature and threshold, leaves from -1 down with a value, and the
    features' names in order as rows of tree -1. Its size is the model's."""
    rows = [(-1, i, name, None, None, None, None, None) for i, name in enumerate(model.feature_names)]
    for t, tree in enumerate(model.trees):
        gain = tree.split_gain or [None] * len(tree.split_feature)
        rows += [(t, i, model.feature_names[f], float(x), lo, hi, g, None) for i, (f, x, lo, hi, g) in enumerate(
            zip(tree.split_feature, tree.threshold, tree.left_child, tree.right_child, gain))]
        rows += [(t, ~i, None, None, None, None, None, float(v)) for i, v in enumerate(tree.leaf_value)]
    return spark.createDataFrame(rows, NODES)


def save_model(spark: SparkSession, model: TreeModel, path: str) -> None:
    """Write the node table as Parquet to ``path``, which must not exist yet."""
    model_nodes(spark, model).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> TreeModel:
    """The model of a node table written by ``save_model``; it scores exactly as before."""
    return nodes_model(spark.read.schema(NODES).parquet(path))


def nodes_model(nodes: DataFrame) -> TreeModel:
    """The model of a node table, whose size is the model's."""
    rows = nodes.collect()
    names = [r["feature"] for r in sorted((r for r in rows if r["tree"] < 0), key=lambda r: r["node"])]
    trees: dict[int, list] = {}
    for r in rows:
        if r["tree"] >= 0:
            trees.setdefault(r["tree"], []).append(r)

    def tree(nodes: list) -> Tree:
        inner = sorted((r for r in nodes if r["node"] >= 0), key=lambda r: r["node"])
        leaf = sorted((r for r in nodes if r["node"] < 0), key=lambda r: -r["node"])
        gain = [r["gain"] for r in inner]
        return Tree([names.index(r["feature"]) for r in inner], [r["threshold"] for r in inner], [r["left_child"] for r in inner],
                    [r["right_child"] for r in inner], [r["value"] for r in leaf], gain if None not in gain else [])

    return TreeModel(names, [tree(trees[t]) for t in sorted(trees)])

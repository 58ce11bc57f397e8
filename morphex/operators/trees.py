"""Trees over bounded cohorts: average linkage, cuts, clades, support, neighbour joining, rooting, phylogenetic diversity.

Linkage needs the whole distance matrix of a cohort in one task, which the pair budget bounds. What follows from a
merge table (cuts at many cutoffs, scans, monophyly) is relational again, replicates run as tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import with_positions

#: Rows of a cohort that one task may hold as a full matrix (n^2 * 8 bytes: 3.2 GB).
MOST_TIPS = 20_000


def check_tips(n: int) -> None:
    if n > MOST_TIPS:
        raise ValueError(f"{n} rows; a tree holds {MOST_TIPS} at most")


def square(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = d
    return m


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    u = x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-12)[:, None]
    d = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(d, 0)
    return (d + d.T) / 2


def average_linkage(matrix: np.ndarray) -> np.ndarray:
    """(n - 1) x 4 merges (a, b, height, size) by average linkage; new nodes are n, n + 1, ... by rising height.

    Nearest-neighbour chains, so n^2 steps in all; ties go to the lesser index.
    """
    n = len(matrix)
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = d[chain[-1]]
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                break
            chain.append(j)
        i, j = sorted((chain.pop(), chain.pop()))
        found.append((float(d[i, j]), i, j))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
    order = sorted(range(n - 1), key=lambda k: (found[k][0], k))
    root, count, out = list(range(n)), [1] * n, np.zeros((max(0, n - 1), 4))
    node = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for step, k in enumerate(order):
        h, i, j = found[k]
        p, q = find(i), find(j)
        a, b = sorted((node[p], node[q]))
        root[q] = p
        count[p] += count[q]
        node[p] = n + step
        out[step] = a, b, h, count[p]
    return out


def merge_table(pairs: DataFrame, ids: list) -> DataFrame:
    """(step, a, b, height, size) of the average linkage of a pair table; node k < len(ids) is ids[k]. One task."""
    check_tips(len(ids))
    n = len(ids)

    def run(table: pa.Table) -> pa.Table:
        known = pa.array(ids, table.schema.field("i").type)
        i, j = (pc.index_in(table.column(c), value_set=known).to_numpy().astype(np.int64) for c in ("i", "j"))
        z = average_linkage(square(n, i, j, table.column("d").to_numpy()))
        return pa.table([np.arange(len(z)), z[:, 0].astype(np.int64), z[:, 1].astype(np.int64), z[:, 2], z[:, 3].astype(np.int64)], names=["step", "a", "b", "height", "size"])

    return pairs.groupBy(F.lit(0).alias("_")).applyInArrow(run, "step long, a long, b long, height double, size long")


def merges_array(merges: DataFrame) -> np.ndarray:
    rows = merges.orderBy("step").limit(MOST_TIPS + 1).collect()
    check_tips(len(rows))
    return np.array([[r.a, r.b, r.height, r["size"]] for r in rows]).reshape(-1, 4)


def cut(z: np.ndarray, n: int, cutoff: float) -> np.ndarray:
    """Cluster of each tip when only merges up to ``cutoff`` hold; numbered by first tip."""
    root = list(range(n + len(z)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for step, (a, b, h, _) in enumerate(z):
        if h <= cutoff:
            root[find(int(a))] = n + step
            root[find(int(b))] = n + step
    first: dict[int, int] = {}
    return np.array([first.setdefault(find(k), len(first)) for k in range(n)], int)


def partitions(spark: SparkSession, z: np.ndarray, ids: list, cutoffs: Iterable[float], prefix: str = "OTU") -> DataFrame:
    """(cutoff, id, cluster) for every cutoff, one task a cutoff; clusters are prefix_1, ... by falling size, ties by first tip."""
    n = len(ids)

    def run(batches):
        for batch in batches:
            for t in batch.column("cutoff").to_pylist():
                label = cut(z, n, t)
                rank = np.argsort(np.argsort(-np.bincount(label), kind="stable"), kind="stable") if n else label
                yield pa.RecordBatch.from_arrays([pa.array([t] * n), pa.array(ids), pa.array([f"{prefix}_{rank[k] + 1}" for k in label])], names=["cutoff", "id", "cluster"])

    kind = "long" if ids and isinstance(ids[0], int) else "string"
    cuts = sorted({float(c) for c in cutoffs})
    return spark.createDataFrame([(c,) for c in cuts], "cutoff double").repartition(max(1, min(len(cuts), 64)), "cutoff").mapInArrow(run, f"cutoff double, id {kind}, cluster string")


def partition_scan(merges: DataFrame, cutoffs: DataFrame, n: int) -> DataFrame:
    """(cutoff, clusters): n less the merges up to each cutoff; relational."""
    met = cutoffs.join(F.broadcast(merges.select("height")), F.col("height") <= F.col("cutoff"), "left")  # at most MOST_TIPS merges
    return met.groupBy("cutoff").agg((F.lit(n) - F.count("height")).alias("clusters"))


def clades(z: np.ndarray, n: int) -> list[frozenset[int]]:
    """Tips under every merge but the last, with more than one tip."""
    below: list[frozenset[int]] = [frozenset([k]) for k in range(n)]
    for a, b, _, _ in z:
        below.append(below[int(a)] | below[int(b)])
    return [c for c in below[n:] if 1 < len(c) < n]


def clade_positions(z: np.ndarray, ids: list) -> list[tuple[int, float, float, int]]:
    """(node, height, y, size) of every merge but the whole tree; y is the middle between its two parts, tips lie at 0, 1, ... in leaf order."""
    n = len(ids)
    y = np.zeros(n + len(z))
    y[leaf_order(z, n)] = np.arange(n)
    out = []
    for step, (a, b, height, size) in enumerate(z):
        y[n + step] = (y[int(a)] + y[int(b)]) / 2
        if 1 < size < n:
            out.append((n + step, float(height), float(y[n + step]), int(size)))
    return out


def node_tips(z: np.ndarray, ids: list) -> list[tuple[int, object]]:
    """(node, tip) closure of a merge table, tips included."""
    n, out = len(ids), [[k] for k in range(len(ids))]
    for a, b, _, _ in z:
        out.append(out[int(a)] + out[int(b)])
    return [(node, ids[t]) for node, tips in enumerate(out) for t in tips]


def monophyly(closure: DataFrame, labels: DataFrame) -> DataFrame:
    """One row proportion: labels whose rows are exactly the labelled rows under some node; null without labels.

    ``closure``: (node, tip), ``labels``: (tip, label). Unlabelled tips are neutral.
    """
    known = labels.where(F.col("label").isNotNull())
    total = known.join(closure.select("tip").distinct(), "tip", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    under = closure.join(known, "tip").groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
    all_ = under.groupBy("node").agg(F.sum("k").alias("all"))
    good = under.join(all_, "node").join(total, "label").where((F.col("k") == F.col("n")) & (F.col("all") == F.col("n"))).select("label").distinct().withColumn("ok", F.lit(1))
    return total.join(good, "label", "left").agg((F.count("ok") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("proportion"))


def replicate_columns(dims: int, replicates: int, ratio: float, seed: int, replace: bool) -> list[np.ndarray]:
    """Columns drawn for each replicate: one seed per replicate from the master generator."""
    if dims < 2 or not np.isfinite(ratio) or ratio <= 0 or (not replace and max(2, round(dims * ratio)) > dims):
        raise ValueError("resampling needs two dimensions or more and a draw of at most all of them")
    seeds = np.random.default_rng(seed).integers(0, 2**32, replicates)
    size = dims if replace else max(2, round(dims * ratio))
    return [np.random.default_rng(int(s)).choice(dims, size, replace=replace) for s in seeds]


def _replicated(spark: SparkSession, x: np.ndarray, draws: list[np.ndarray], tree_sets) -> DataFrame:
    """(replicate, clade): the sets that ``tree_sets(matrix)`` yields for each replicate's columns, a task a few replicates."""
    if x.nbytes > 512 << 20:
        raise ValueError("the cohort is too large to resample")

    def run(batches):
        for batch in batches:
            for r in batch.column("id").to_pylist():
                y = x[:, draws[r]]
                y = np.where((np.abs(y).sum(axis=1) == 0)[:, None], 1e-12, y)
                sets = [sorted(c) for c in tree_sets(cosine_matrix(y))]
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["replicate", "clade"])

    return spark.range(0, len(draws), 1, max(1, min(len(draws), 64))).mapInArrow(run, "replicate long, clade array<long>")


def upgma_support(spark: SparkSession, x: np.ndarray, replicates: int = 100, ratio: float = 0.8, seed: int = 42, replace: bool = False) -> DataFrame:
    """(clade, support): percentage of replicates (columns drawn anew) whose tree holds each clade of the full tree."""
    n = len(x)
    check_tips(n)
    draws = replicate_columns(x.shape[1], replicates, ratio, seed, replace)
    held = _replicated(spark, x, draws, lambda m: clades(average_linkage(m), n)).groupBy("clade").agg(F.count(F.lit(1)).alias("k"))
    whole = [(sorted(c),) for c in clades(average_linkage(cosine_matrix(x)), n)]
    return spark.createDataFrame(whole, "clade array<long>").join(held, "clade", "left").select("clade", (F.coalesce("k", F.lit(0)) * 100.0 / replicates).alias("support"))


@dataclass
class Node:
    """A tree node: its name, the length of the branch above it, and its children."""

    name: str = ""
    length: float = 0.0
    children: list[Node] = field(default_factory=list)

    def tips(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            stack.extend(reversed(x.children))
            if not x.children:
                out.append(x.name)
        return out

    def walk(self) -> list[tuple[Node, Node | None]]:
        """(node, parent), parents first."""
        out, stack = [], [(self, None)]
        while stack:
            x, parent = stack.pop()
            out.append((x, parent))
            stack.extend((c, x) for c in reversed(x.children))
        return out


def from_merges(z: np.ndarray, ids: list) -> Node:
    nodes = [Node(str(i)) for i in ids]
    height = [0.0] * len(ids)
    for a, b, h, _ in z:
        a, b = int(a), int(b)
        for k in (a, b):
            nodes[k].length = float(h) - height[k]
        nodes.append(Node(children=[nodes[a], nodes[b]]))
        height.append(float(h))
    return nodes[-1] if nodes else Node()


def leaf_order(z: np.ndarray, n: int) -> list[int]:
    """Tips in the order of a drawn dendrogram: depth first, first child first."""
    out, stack = [], [n + len(z) - 1 if len(z) else 0]
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            stack += [int(z[k - n, 1]), int(z[k - n, 0])]
    return out


def to_newick(root: Node, support: dict[frozenset[str], float] | None = None) -> str:
    """Newick text: lengths to ten places, support to one, names quoted where they must be."""

    def name(x: str) -> str:
        return "'" + x.replace("'", "''") + "'" if any(c in "()[]{}:;,'\" \t\n" for c in x) else x

    text: dict[int, str] = {}
    below: dict[int, frozenset[str]] = {}
    for node, parent in reversed(root.walk()):
        if node.children:
            below[id(node)] = frozenset().union(*(below[id(c)] for c in node.children))
            mark = support.get(below[id(node)]) if support else None
            body = "(" + ",".join(text[id(c)] for c in node.children) + ")" + (f"{mark:.1f}" if mark is not None else name(node.name))
        else:
            below[id(node)], body = frozenset([node.name]), name(node.name)
        text[id(node)] = body + (f":{node.length:.10f}" if parent is not None else "")
    return text[id(root)] + ";"


def parse_newick(text: str) -> Node:
    """Any Newick tree: quoted names, comments in brackets, any number of children; underscores stay."""
    root = Node()
    path, current, i, n = [], root, 0, len(text)
    fresh = ""

    def word(i: int) -> tuple[str, int]:
        if text[i] == "'":
            out, i = [], i + 1
            while True:
                j = text.find("'", i)
                if j < 0:
                    raise ValueError("unclosed quote")
                out.append(text[i:j])
                if text[j + 1 : j + 2] != "'":
                    return "".join(out), j + 1
                out.append("'")
                i = j + 2
        j = i
        while j < n and text[j] not in "()[],:;":
            j += 1
        return text[i:j].strip(), j

    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "[":
            i = text.index("]", i) + 1
        elif c == "(":
            child = Node()
            current.children.append(child)
            path.append(current)
            current, i = child, i + 1
        elif c == ",":
            if not path:
                raise ValueError("comma outside parentheses")
            current = Node()
            path[-1].children.append(current)
            i += 1
        elif c == ")":
            if not path:
                raise ValueError("unbalanced parentheses")
            current, i = path.pop(), i + 1
        elif c == ":":
            fresh, i = word(i + 1)
            current.length = float(fresh)
        elif c == ";":
            break
        else:
            current.name, i = word(i)
    if path:
        raise ValueError("unbalanced parentheses")
    return root


def clade_supports(root: Node, ids: set[str]) -> dict[frozenset[str], float]:
    """{tips: support} of the inner nodes whose name is a number; empty if the tree has a tip that isn't in ``ids``."""
    if not set(root.tips()) <= ids:
        return {}
    out = {}
    for node, _ in root.walk():
        if node.children and node.name:
            try:
                out[frozenset(node.tips())] = float(node.name)
            except ValueError:
                continue
    return out


def neighbour_joining(matrix: np.ndarray, names: list[str]) -> Node:
    """Unrooted neighbour-joining tree with a root of three children; negative branches are cut to 0."""
    d = (matrix + matrix.T) / 2
    nodes = [Node(str(x)) for x in names]
    if len(nodes) < 3:
        for node in nodes:
            node.length = float(d[0, 1]) / 2 if len(nodes) == 2 else 0.0
        return Node(children=nodes)
    while len(nodes) > 3:
        k, r = len(nodes), d.sum(axis=1)
        q = (k - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), k))
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (k - 2))
        nodes[i].length, nodes[j].length = max(0.0, float(li)), max(0.0, float(d[i, j] - li))
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [x for x in range(k) if x not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        nodes = [nodes[x] for x in keep] + [Node(children=[nodes[i], nodes[j]])]
    for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
        nodes[a].length = max(0.0, float(d[a, b] + d[a, c] - d[b, c]) / 2)
    return Node(children=nodes)


def bipartitions(root: Node, order: list[str]) -> set[frozenset[int]]:
    """Splits of an unrooted tree as the side without the first name; trivial ones left out."""
    place, out = {x: k for k, x in enumerate(order)}, set()
    everything = frozenset(range(len(order)))
    for node, parent in root.walk():
        if parent is not None and node.children:
            side = frozenset(place[t] for t in node.tips())
            side = everything - side if 0 in side else side
            if 1 < len(side) < len(order) - 1:
                out.add(side)
    return out


def neighbour_joining_support(spark: SparkSession, x: np.ndarray, names: list[str], replicates: int = 100, ratio: float = 0.8, seed: int = 42, replace: bool = False, least: float = 50.0) -> DataFrame:
    """(clade, support) of the splits that more than ``least`` percent of the replicates' trees hold (majority rule)."""
    draws = replicate_columns(x.shape[1], replicates, ratio, seed, replace)
    held = _replicated(spark, x, draws, lambda m: bipartitions(neighbour_joining(m, names), names))
    counted = held.groupBy("clade").agg((F.count(F.lit(1)) * 100.0 / replicates).alias("support")).where(F.col("support") > least)
    table = F.array(*(F.lit(n) for n in names))
    return counted.select(F.transform("clade", lambda k: F.get(table, k.cast("int"))).alias("clade"), "support")


def midpoint_rooted(root: Node) -> Node:
    """The tree rooted in the middle of its longest path between tips."""
    link: dict[int, list[tuple[int, float]]] = {}
    nodes: dict[int, Node] = {}
    for node, parent in root.walk():
        nodes[id(node)] = node
        link.setdefault(id(node), [])
        if parent is not None:
            link[id(node)].append((id(parent), node.length))
            link[id(parent)].append((id(node), node.length))

    def farthest(start: int) -> tuple[int, dict[int, float], dict[int, int]]:
        far, back, stack = {start: 0.0}, {}, [start]
        while stack:
            k = stack.pop()
            for m, w in link[k]:
                if m not in far:
                    far[m], back[m] = far[k] + w, k
                    stack.append(m)
        tips = [k for k in far if not nodes[k].children]
        return max(tips, key=lambda k: (far[k], nodes[k].name)), far, back

    tips = [k for k, x in nodes.items() if not x.children]
    if len(tips) < 2:
        return root
    a, _, _ = farthest(tips[0])
    b, far, back = farthest(a)
    half, k = far[b] / 2, b
    while k != a and far[back[k]] > half:
        k = back[k]
    top = Node()
    if k == a:
        return root
    lower, upper = k, back[k]

    def grow(k: int, source: int, length: float) -> Node:
        out = Node(nodes[k].name, length)
        stack = [(k, source, out)]
        while stack:
            x, came, made = stack.pop()
            for m, w in link[x]:
                if m != came:
                    child = Node(nodes[m].name, w)
                    made.children.append(child)
                    stack.append((m, x, child))
        return out

    top.children = [grow(lower, upper, far[lower] - half), grow(upper, lower, half - far[upper])]
    # an inner node that lost its third branch is passed through
    for node, _ in top.walk():
        for at, c in enumerate(node.children):
            while len(c.children) == 1:
                only = c.children[0]
                only.length += c.length
                node.children[at] = c = only
    return top


def sheared(root: Node, keep: set[str]) -> Node | None:
    """The tree over the tips in ``keep``, rooted at their last common ancestor; null if none is left."""
    made: dict[int, Node | None] = {}
    for node, _ in reversed(root.walk()):
        if not node.children:
            made[id(node)] = Node(node.name, node.length) if node.name in keep else None
            continue
        left = [c for c in (made[id(x)] for x in node.children) if c is not None]
        if len(left) == 1:
            left[0].length += node.length
            made[id(node)] = left[0]
        else:
            made[id(node)] = Node(node.name, node.length, left) if left else None
    out = made[id(root)]
    if out is not None:
        out.length = 0.0
    return out


def tree_tables(spark: SparkSession, root: Node) -> tuple[DataFrame, DataFrame]:
    """(node, parent, length, name, is_tip) and the closure (node, tip)."""
    number: dict[int, int] = {}
    rows, pairs = [], []
    for node, parent in root.walk():
        number[id(node)] = len(number)
        rows.append((number[id(node)], None if parent is None else number[id(parent)], float(node.length), node.name or None, not node.children))
    for node, _ in root.walk():
        pairs += [(number[id(node)], t) for t in node.tips()]
    return spark.createDataFrame(rows, "node long, parent long, length double, name string, is_tip boolean"), spark.createDataFrame(pairs, "node long, tip string")


def phylogenetic_diversity(nodes: DataFrame, closure: DataFrame, counts: DataFrame) -> DataFrame:
    """(sample, richness, faith_pd, weighted_rooted, weighted_unrooted, pd_richness_norm) from counts (sample, tip, n).

    A branch counts with the individuals below it: fully if there are any (Faith), by their share p, or by 2 min(p, 1 - p).
    Tips that the tree lacks don't count. A join on tips and two aggregations; the tree may be of any size.
    """
    seen = counts.where(F.col("n") > 0).join(closure.select("tip").distinct(), "tip", "left_semi")
    totals = seen.groupBy("sample").agg(F.sum("n").alias("N"), F.countDistinct("tip").alias("richness"))
    below = seen.join(closure, "tip").groupBy("sample", "node").agg(F.sum("n").alias("k"))
    edges = nodes.where(F.col("parent").isNotNull()).select("node", "length")
    t = totals.withColumnRenamed("sample", "s")
    x = below.join(edges, "node").join(t, F.col("sample").eqNullSafe(F.col("s")))
    p = F.col("k") / F.col("N")
    return x.groupBy("sample", "richness").agg(F.sum("length").alias("faith_pd"), F.sum(F.col("length") * p).alias("weighted_rooted"), F.sum(F.col("length") * 2 * F.least(p, 1 - p)).alias("weighted_unrooted")).withColumn("pd_richness_norm", F.col("faith_pd") / F.col("richness"))


#: Clusters whose centroids may come to the driver for a tree.
MOST_CLUSTERS = 3_000


def centroid_tree(centroids: DataFrame, key: str = "cluster") -> Node | None:
    """Neighbour-joining tree of cluster centroids (key, centroid); null below three clusters."""
    rows = centroids.select(F.col(key).cast("string").alias("k"), "centroid").orderBy("k").limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    if len(rows) < 3:
        return None
    return neighbour_joining(cosine_matrix(np.array([r.centroid for r in rows])), [r.k for r in rows])


def diversity_from_vectors(assignments: DataFrame, centroids: DataFrame) -> DataFrame | None:
    """Per sample and over all: MPD (Faith on the midpoint-rooted tree), MPD_w (unrooted weighted), and MPD by richness.

    ``assignments``: counts (sample, cluster, n). Null below three clusters.
    """
    root = centroid_tree(centroids)
    if root is None:
        return None
    spark = assignments.sparkSession
    counts = assignments.select("sample", F.col("cluster").cast("string").alias("tip"), "n")
    faith = phylogenetic_diversity(*tree_tables(spark, midpoint_rooted(root)), counts).select("sample", "richness", F.col("faith_pd").alias("MPD"), F.col("pd_richness_norm").alias("MPD_richness_norm"))
    weighted = phylogenetic_diversity(*tree_tables(spark, root), counts).select(F.col("sample").alias("s"), F.col("weighted_unrooted").alias("MPD_w"))
    return faith.join(weighted, F.col("sample").eqNullSafe(F.col("s"))).drop("s")


def contiguous_runs(rows: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, first, last, n): maximal runs of equal values in ``order``, which must be unique within ``by``.

    Gaps and islands over two positions, both from range partitions, so that one long sequence spreads over many tasks.
    """
    by = by or []
    placed = with_positions(rows.select(*by, value, order), by, [order]).withColumnRenamed("position", "_all")
    placed = with_positions(placed, [*by, value], [order]).withColumn("_g", F.col("_all") - F.col("position"))
    return placed.groupBy(*by, value, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")

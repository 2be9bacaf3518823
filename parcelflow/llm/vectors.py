"""Near-duplicate embeddings by a robust-pruned flat graph, after DiskANN's merged shards.

1. Equal vectors become one node with a weight. Vectors that are null, empty, zero or hold null or non-finite parts link
   with nothing; shorter vectors count as padded with zeros.
2. Centroids are fitted on a bounded sample; above MAX_CLUSTERS of them, each cluster is parted again by centroids fitted on a
   bounded sample of its own members, in the executors. A node ranks the leaves by similarity and goes to the shards of its OVERLAP
   nearest. A leaf that is still crowded (near copies) is dealt out over several shards by hash, so a shard's size is bounded.
3. Each shard builds a graph: candidates are a node's nearest and some random nodes, pruned robustly (alpha), plus reverse
   edges. A node's adjacency lists from all its shards are united into one flat graph.
4. Each node is a query, routed to the shards of its nearest leaves. There, a greedy beam search starts from the shard's
   medoids; then the range is expanded: every node within the threshold passes on to its neighbours until no new one is in
   range. Hits are verified by cosine in double precision.
5. Two nodes may meet in several shards, either asking the other. Which of these meetings decides follows from their ranked leaves
   alone, so a link found there counts once at both its ends, and nowhere else. A task returns a count for each node and a spanning
   forest of the links, never the pairs, so a large group of near copies costs rows in proportion to its size.
6. Recall is audited against brute force for a bounded sample of queries over all nodes, over all their links and as the mean of
   the queries. Below the target the search is repeated with twice the beam and routes, then through all leaves, at last by
   holding each query against every node. The audit is logged and can be had (see near_duplicates).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import durable
from parcelflow.llm.components import connected_components

SAMPLE, CLUSTER, MAX_CLUSTERS, SHARD, QUERIES = 16_384, 1200, 512, 3000, 8000
OVERLAP, ROUTES, BEAM = 2, 3, 24
DEGREE, NEAR, RANDOM, ALPHA, ALWAYS = 20, 40, 12, 1.2, 4
AUDIT, RECALL, LEAST_RECALL = 1000, 0.97, 0.9
#: So many of a node's nearest leaves are ranked; a search through more goes through all. Leaves of the TOPS nearest clusters are compared.
RANKED, TOPS = 64, 4
#: Up to so many leaves, tables with a row a leaf are broadcast (16 bytes each).
SMALL = 10_000
LOG = logging.getLogger(__name__)


def matrix(column, width: int):
    """An Arrow list column as float64 rows of `width`, padded with zeros."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def unit(x):
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    import numpy as np

    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x, k: int, rounds: int = 6):
    """Spherical k-means from evenly spaced rows of x, which come in random order: dense regions get more centroids."""
    import numpy as np

    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def prune(x, seed: int):
    """Adjacency (n, at most 2 * DEGREE) of the rows of x, -1 where there is no more: robust pruning, then reverse edges."""
    import numpy as np

    n = len(x)
    r = np.random.default_rng(seed)
    chosen = []
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        k = min(NEAR, n - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(rows), 0), int)
        cand = np.concatenate((near, r.integers(0, n, (len(rows), RANDOM))), axis=1)
        sim = np.take_along_axis(s, cand, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        y = x[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * (y @ y.transpose(0, 2, 1))))
        away = np.sqrt(np.maximum(0, 2 - 2 * sim))
        alive, kept = sim > -2, np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            take = alive[:, j] & (kept.sum(1) < DEGREE) if j >= ALWAYS else sim[:, j] > -2
            kept[:, j] = take
            alive &= ~(take[:, None] & (ALPHA * between[:, j] <= away))
        i, j = np.nonzero(kept)
        chosen.append(np.stack((rows[i], cand[i, j]), 1))
    edge = np.concatenate(chosen) if chosen else np.empty((0, 2), int)
    edge = np.unique(np.concatenate((edge, edge[:, ::-1])), axis=0)
    near = np.einsum("ij,ij->i", x[edge[:, 0]], x[edge[:, 1]])
    edge = edge[np.lexsort((-near, edge[:, 0]))]
    at = np.arange(len(edge)) - np.searchsorted(edge[:, 0], edge[:, 0])
    edge, at = edge[at < 2 * DEGREE], at[at < 2 * DEGREE]
    out = np.full((n, 2 * DEGREE), -1)
    out[edge[:, 0], at] = edge[:, 1]
    return out


def medoids(x, k: int = 4):
    import numpy as np

    return np.unique((x @ centroids(x, k, 2).T).argmax(0)).tolist() + [int((x @ x.mean(0)).argmax())]


def range_search(q, x, adj, starts, least: float, beam: int):
    """Pairs (query, node) of rows of q and x whose product is at least `least`, found over adj from the starts."""
    import numpy as np

    b, n = len(q), len(x)
    seen = np.zeros(b * n, bool)
    hits = []

    def visit(flat):
        """New pairs among flat, with their products."""
        flat = np.unique(flat[~seen[flat]])
        seen[flat] = True
        sim = np.einsum("ij,ij->i", q[flat // n], x[flat % n])
        hits.append(flat[sim >= least])
        return flat, sim

    def around(flat):
        next_ = adj[flat % n]
        ok = next_ >= 0
        return ((flat // n * n)[:, None] + next_)[ok]

    ids, sims = np.full((b, beam), -1), np.full((b, beam), -9.0, np.float32)
    done = np.zeros((b, beam), bool)
    flat, sim = visit((np.arange(b)[:, None] * n + np.array(starts)).ravel())
    while True:  # the best four of each query's beam are expanded at a time
        owner = flat // n
        order = np.lexsort((-sim, owner))
        flat, sim, owner = flat[order], sim[order], owner[order]
        at = np.arange(len(flat)) - np.searchsorted(owner, owner)
        few = at < beam
        more_i, more_s = np.full((b, beam), -1), np.full((b, beam), -9.0, np.float32)
        more_i[owner[few], at[few]], more_s[owner[few], at[few]] = flat[few] % n, sim[few]
        all_i, all_s = np.concatenate((ids, more_i), 1), np.concatenate((sims, more_s), 1)
        all_d = np.concatenate((done, np.zeros_like(done)), 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(v, top, 1) for v in (all_i, all_s, all_d))
        fresh = ~done & (ids >= 0)
        fresh &= np.cumsum(fresh, axis=1) <= 4
        if not fresh.any():
            break
        done |= fresh
        i, j = np.nonzero(fresh)
        flat, sim = visit(around(i * n + ids[i, j]))
    grown = np.concatenate(hits)
    while len(grown):
        new = []
        for a in range(0, len(grown), 20_000):
            hits.clear()
            visit(around(grown[a : a + 20_000]))
            new.append(hits[0])
        grown_before, grown = grown, np.concatenate(new)
        yield grown_before
    yield grown


def all_pairs(q, x, least: float):
    """As range_search, by every product; a few rows of q at a time, so that memory is bounded."""
    import numpy as np

    for a in range(0, len(q), 16):
        i, j = np.nonzero(q[a : a + 16] @ x.T >= least)
        yield (a + i) * len(x) + j


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, audit: list | None = None) -> DataFrame:
    """(id, n_links, component_id, kept): a row for each row of vectors.

    n_links counts the other rows linked directly. component_id is the smallest id reachable, null ids not counting unless
    there is no other. Rows with a vector that cannot link stand alone. An empty table gives an empty one. Other columns, whatever
    their names, are not looked at. A dict for each search made, with its routes (None: all leaves), beam (0: every pair) and both
    recalls, is appended to `audit`; a last one below LEAST_RECALL raises.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.forall("vec", finite) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("vec", F.when(good, F.col("vec")))
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    nodes = durable(nodes.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("vec").alias("h"), "*"), "nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n:
        counts, links = _search(nodes, n, width, least, [] if audit is None else audit)
        groups = connected_components(links)
        named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = durable(named.join(counts, "node", "left").select("vec", "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
        named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("vec", "n_links", "component_id")
    else:
        named = nodes.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    out = rows.join(named, "vec", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))


def _sampled(nodes: DataFrame, n: int, count: int, salt: str):
    share = min(1.0, 1.2 * count / n)
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit(salt), "h"), F.lit(1_000_000)) < share * 1_000_000)
    return drawn.orderBy(F.xxhash64(F.lit(salt), "h"), "h").limit(count).toArrow()


def ranked(nodes: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """(node, h, weight, vec, near), near being at most RANKED leaves by falling similarity; and the number of leaves, from 0 on."""
    import numpy as np
    import pyarrow as pa

    wanted = max(1, round(n / CLUSTER))
    c = centroids(unit(matrix(_sampled(nodes, n, SAMPLE, "fit")["vec"], width)), min(MAX_CLUSTERS, wanted)).astype(np.float32)
    most = RANKED if wanted <= MAX_CLUSTERS else TOPS

    def assign(batches):
        for batch in batches:
            s = unit(matrix(batch["vec"], width)).astype(np.float32) @ c.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :most].astype(np.int32)
            yield batch.append_column("near", pa.array(list(near), pa.list_(pa.int32())))

    schema = "node long, h long, weight long, vec array<double>, near array<int>"
    near = durable(nodes.select("node", "h", "weight", "vec").mapInArrow(assign, schema), "near")
    if wanted <= MAX_CLUSTERS:
        return near, len(c)
    sizes = {r[0]: r[1] for r in near.groupBy(F.col("near")[0].alias("cluster")).count().collect()}  # at most MAX_CLUSTERS rows
    leaves = [max(1, round(sizes.get(k, 0) / CLUSTER)) for k in range(len(c))]
    first = np.concatenate(([0], np.cumsum(leaves)))
    cluster = F.col("near")[0]
    share = F.element_at(F.array(*[F.lit(int(1e6 * min(1.0, 16 * leaves[k] / max(1, sizes.get(k, 0))))) for k in range(len(c))]), cluster + 1)
    drawn = near.where(F.pmod(F.xxhash64(F.lit("leaf"), "h"), F.lit(1_000_000)) < share).select(cluster.alias("cluster"), "h", "vec")

    def fit(key, group):
        k = key[0].as_py()
        x = unit(matrix(group.sort_by("h")["vec"], width))
        found = centroids(x, leaves[k]).astype(np.float32)
        return pa.table({"cluster": pa.array([k] * len(found), pa.int32()), "leaf": pa.array(first[k] + np.arange(len(found)), pa.int32()), "vec": pa.array(list(found.astype(np.float64)), pa.list_(pa.float64()))})

    fitted = durable(drawn.groupBy("cluster").applyInArrow(fit, "cluster int, leaf int, vec array<double>"), "leaves")
    parts = F.element_at(F.array(*[F.lit(max(1, -(-TOPS * sizes.get(k, 0) // (4 * QUERIES)))) for k in range(len(c))]), F.col("cluster") + 1)
    asked = near.select("node", "h", "vec", F.explode("near").alias("cluster")).withColumn("part", F.pmod(F.xxhash64(F.lit("rank"), "h"), parts).cast("int")).drop("h")
    fitted = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def rank(left, right):
        if not (left.num_rows and right.num_rows):
            return pa.table({"node": pa.array([], pa.int64()), "sim": pa.array([], pa.list_(pa.float32())), "leaf": pa.array([], pa.list_(pa.int32()))})
        s = unit(matrix(left["vec"], width)).astype(np.float32) @ unit(matrix(right["vec"], width)).astype(np.float32).T
        top = np.argsort(-s, axis=1, kind="stable")[:, :RANKED]
        leaf = right["leaf"].to_numpy()[top]
        return pa.table({"node": left["node"], "sim": pa.array(list(-np.take_along_axis(s, top, 1)), pa.list_(pa.float32())), "leaf": pa.array(list(leaf.astype(np.int32)), pa.list_(pa.int32()))})

    told = asked.groupBy("cluster", "part").cogroup(fitted.groupBy("cluster", "part")).applyInArrow(rank, "node long, sim array<float>, leaf array<int>")
    lists = told.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("sim", "leaf")))).alias("s"))  # TOPS lists of RANKED at most
    lists = lists.select("node", F.slice(F.col("s.leaf"), 1, RANKED).alias("near"))
    return durable(near.drop("near").join(lists, "node"), "ranked"), int(first[-1])


def deciding(c, q, x, mq, mx, rq, rx):
    """Of meetings at leaf c where node q asked and met x: whether this one decides on the pair. mq, mx: the leaves they are filed
    under; rq, rx: those they ask, None for all. By rank, first the one with the smaller number asking."""
    import numpy as np

    mine, open_, q_low = np.zeros(len(q), bool), np.ones(len(q), bool), q < x
    at = lambda m, r: m >= 0 if r is None else ((m[:, None] == r).any(1) & (m >= 0))
    for k in range(mx.shape[1]):
        q_asks, x_asks = at(mx[:, k], rq), at(mq[:, k], rx)
        here = q_asks & (mx[:, k] == c)
        mine |= open_ & here & (q_low | ~x_asks)
        open_ &= ~(q_asks | x_asks)
    return mine


def _search(nodes: DataFrame, n: int, width: int, least: float, audit: list) -> tuple[DataFrame, DataFrame]:
    import numpy as np
    import pyarrow as pa

    near, n_leaves = ranked(nodes, n, width)
    filed = F.explode(F.slice("near", 1, OVERLAP)).alias("cluster")
    some = (lambda t: F.broadcast(t)) if n_leaves <= SMALL else (lambda t: t.hint("merge"))
    sizes = durable(near.select(filed).groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("split")), "sizes")  # a row a leaf
    members = near.select("node", "h", "weight", "vec", "near", filed).join(some(sizes), "cluster")
    members = members.withColumn("sub", F.pmod("h", "split").cast("int")).drop("h", "split")

    def build(key, group):
        x = unit(matrix(group["vec"], width)).astype(np.float32)
        ids, adj = group["node"].to_numpy(), prune(x, 100_003 * key[0].as_py() + key[1].as_py())
        return pa.table({"node": ids, "next": pa.array([ids[a[a >= 0]] for a in adj], pa.list_(pa.int64()))})

    built = members.groupBy("cluster", "sub").applyInArrow(build, "node long, next array<long>")
    flat = durable(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "graph")  # OVERLAP lists a node

    def lists(column, most: int):
        """Lists as rows of `most`, -1 where there is no more."""
        out = np.full((len(column), most), -1, np.int64)
        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        lengths = np.minimum(np.diff(column.offsets.to_numpy()), most)
        starts = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
        values = column.flatten().to_numpy()
        for k in range(most):
            has = lengths > k
            out[has, k] = values[starts[has] + k]
        return out

    def look(left, right, beam, routes):
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        kind = []
        if left.num_rows and right.num_rows:
            ids, weight, leaf = left["node"].to_numpy(), left["weight"].to_numpy(), left["cluster"][0].as_py()
            exact, asked = unit(matrix(left["vec"], width)), unit(matrix(right["vec"], width))
            x, who, asker_weight = exact.astype(np.float32), right["node"].to_numpy(), right["weight"].to_numpy()
            far = max(OVERLAP, routes or 0)
            of_x, of_q = lists(left["near"], far), lists(right["near"], far)
            to = left["next"].combine_chunks()
            owner, to = np.repeat(np.arange(len(ids)), np.diff(to.offsets.to_numpy())), to.flatten().to_numpy()
            order = np.argsort(ids)
            at = np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)
            here = ids[order][at] == to  # the other ends lie in this shard
            owner, to = owner[here], order[at[here]]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            adj = np.full((len(ids), max(1, place.max(initial=0) + 1)), -1)
            adj[owner, place] = to
            starts = medoids(x)
            names = np.unique(np.concatenate((ids, who)))
            root, count = np.arange(len(names)), np.zeros(len(names), np.int64)
            of_names = np.searchsorted(names, ids)
            for k in range(0, len(who), 256):
                q = asked[k : k + 256]
                for flat in range_search(q.astype(np.float32), x, adj, starts, least - 1e-4, beam) if beam else all_pairs(q.astype(np.float32), x, least - 1e-4):
                    i, j = flat // len(ids), flat % len(ids)
                    for p in range(0, len(i), 100_000):
                        u, v = i[p : p + 100_000], j[p : p + 100_000]
                        ok = (np.einsum("ij,ij->i", q[u], exact[v]) >= least) & (who[k + u] != ids[v])
                        u, v = k + u[ok], v[ok]
                        asks = (None, None) if routes is None else (of_q[u, :routes], of_x[v, :routes])
                        mine = deciding(leaf, who[u], ids[v], of_q[u, :OVERLAP], of_x[v, :OVERLAP], *asks)
                        u, v = u[mine], v[mine]
                        one, two = np.searchsorted(names, who[u]), of_names[v]
                        np.add.at(count, one, weight[v])
                        np.add.at(count, two, asker_weight[u])
                        join(root, one, two)
            linked = np.nonzero(count)[0]
            moved = np.nonzero(root != np.arange(len(names)))[0]
            a += [names[linked], names[moved]]
            b += [count[linked], names[root[moved]]]
            kind = [0] * len(linked) + [1] * len(moved)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": np.concatenate(a), "b": np.concatenate(b)})

    def searching(beam: int, routes: int | None):
        def both(left, right):
            return look(left.rename_columns([x.rstrip("_") for x in left.column_names]), right.rename_columns([x.rstrip("_") for x in right.column_names]), beam, routes)

        return both

    # a query's shards; those of one shard are dealt into parts, to each of which the shard's nodes are sent
    beam, routes = BEAM, ROUTES if ROUTES < n_leaves else None
    test = _sampled(nodes, n, AUDIT, "audit")
    truth = _brute(near, unit(matrix(test["vec"], width)), width, least)
    truth = {node: total - own for node, total, own in zip(test["node"].to_pylist(), truth, test["weight"].to_pylist())}
    while True:
        ways = F.explode(F.sequence(F.lit(0), F.lit(n_leaves - 1)) if routes is None else F.slice("near", 1, routes)).alias("cluster")
        reached = near.select(ways).groupBy("cluster").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        plan = durable(sizes.join(reached, "cluster"), "plan")  # a row a leaf
        left = members.join(some(plan.select("cluster", "parts")), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        left = left.join(flat, "node")
        right = near.select("node", "h", "weight", "vec", "near", ways).join(some(plan), "cluster")
        right = right.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "h"), F.col("parts")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
        right = right.select("node", "weight", "vec", "near", "cluster", "sub", "part")
        left, right = left.select(*[F.col(x).alias(f"{x}_") for x in left.columns]), right.select(*[F.col(x).alias(f"{x}__") for x in right.columns])
        looked = left.groupBy("cluster_", "sub_", "part_").cogroup(right.groupBy("cluster__", "sub__", "part__")).applyInArrow(searching(beam, routes), "kind int, a long, b long")
        found = durable(looked, "found")
        counts = durable(found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n")), "counts")
        mine = counts.join(F.broadcast(near.sparkSession.createDataFrame([(k,) for k in truth], "node long")), "node").collect()  # at most AUDIT rows
        got = {r["node"]: r["n"] for r in mine}
        true = {k: v for k, v in truth.items() if v}
        audit.append({
            "routes": routes,
            "beam": beam,
            "pooled": sum(got.get(k, 0) for k in true) / sum(true.values()) if true else 1.0,
            "per_query": sum(min(1.0, got.get(k, 0) / v) for k, v in true.items()) / len(true) if true else 1.0,
        })
        LOG.info("recall %s", audit[-1])
        recall = min(audit[-1]["pooled"], audit[-1]["per_query"])
        if recall >= RECALL or not beam:
            if recall < LEAST_RECALL:
                raise RuntimeError(f"links are missing after every pair was held against each other: {audit[-1]}")
            return counts, found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if routes is None:
            beam = 0  # no graph: every pair
            continue
        beam, routes = 2 * beam, 2 * routes if 2 * routes <= min(RANKED, n_leaves - 1) else None


def join(root, u, v) -> None:
    """Unite the sets of u[i] and v[i] in place; afterwards root holds each member's smallest."""
    import numpy as np

    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _brute(nodes: DataFrame, test, width: int, least: float) -> list[int]:
    """For each of a bounded number of unit rows, the weight of all nodes, itself included, with a product of at least `least`."""
    import numpy as np
    import pyarrow as pa

    def count(batches):
        total = np.zeros(len(test), np.int64)
        for batch in batches:
            x, w = unit(matrix(batch["vec"], width)), batch["weight"].to_numpy()
            for a in range(0, len(x), 4096):
                total += (w[a : a + 4096, None] * (x[a : a + 4096] @ test.T >= least)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(test))), pa.array(total)], ["i", "n"])

    found = nodes.select("vec", "weight").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = {r["i"]: r["n"] for r in found}
    return [n.get(i, 0) for i in range(len(test))]

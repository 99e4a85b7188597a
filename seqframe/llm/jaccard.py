"""Exact components of documents by the Jaccard similarity of their word shingles.

Equal sets are one set from the start. Shingles that many documents hold come
last in each set's order, and only the first part of a set, its prefix, is
indexed: two sets of the wanted similarity share a known least number of prefix
shingles. In short index lists pairs are counted and kept if they reach that
number. A long list belongs to a large group of similar sets: there only the
components are sought, not all links. Sets are compared with a few members of the
list; a list whose sets are all in one component is skipped as a whole. In the
others, a set that has few of its shingles there, say a passage that many texts hold, can link with few
sizes only: what such sets share is counted. Each other set is written as its difference from the shingles that
most of the group's sets hold: what all share makes no candidates, sets near that centre link with
the nearest one for certain, and the rest must share a part of their differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.common import discard, row_key, sliced, text_or_empty, written
from seqframe.llm.graph import components
from seqframe.llm.shingles import Shingler, set_print
from seqframe.llm.url_filter import bloom_blocks, may_contain

#: Shingles sent to the tasks as frequent, at most (8 MB): the most frequent ones. Their choice only orders the index.
MAX_FREQUENT = 1_000_000
#: Shingles a task counts at a time (16 MB), and set identities it keeps to know copies; a full table starts anew.
_MAX_COUNTED = 1_000_000
_MAX_SEEN = 500_000
U = np.uint64


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"),
                       text_or_empty(text_col).alias("text"))


def frequent_shingles(texts: DataFrame, length: int, at_least: int) -> np.ndarray:
    """Sorted prints of shingles that the tasks together saw in ``at_least`` sets.

    A task counts in a table of bounded size; what it saw once when the table
    is full starts anew. Such misses only change the order of the index.
    """

    def run(batches):
        shingler, seen, parts, size = Shingler(length), set(), [], 0
        x, n = np.zeros(0, U), np.zeros(0, np.int64)

        def counted(x, n):
            both = np.concatenate([x, *parts])
            order = np.argsort(both, kind="stable")
            both, own = both[order], np.concatenate([n, np.ones(len(both) - len(n), np.int64)])[order]
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            x, n = both[starts], np.add.reduceat(own, starts) if len(both) else own
            return (x[n > 1], n[n > 1]) if len(x) > _MAX_COUNTED else (x, n)

        def rows(x, n):
            x, n = x[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for piece in sliced(batch, 0):
                for text in piece.column(0).to_pylist():
                    p = shingler.prints(text)
                    if len(p) and (s := set_print(p)) not in seen:
                        seen.add(s)
                        parts.append(p)
                        size += len(p)
                    if size > _MAX_COUNTED:
                        x, n = counted(x, n)
                        parts, size = [], 0
                        if len(x) > _MAX_COUNTED:  # more repeated ones than the table holds: Spark adds them up
                            yield rows(x, n)
                            x, n = x[:0], n[:0]
                if len(seen) > _MAX_SEEN:
                    seen.clear()
        yield rows(*counted(x, n))

    found = (texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= at_least).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).select("token").toArrow())
    return np.sort(found.column("token").to_numpy().view(U))


def index_sets(texts: DataFrame, frequent: np.ndarray, length: int, percent: int) -> DataFrame:
    """(doc_id, key, sid, n, prefix): a set's identity, size and prefix; the prefix is empty if the task had the set before."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        shingler, seen, last = Shingler(length), set(), sent.value
        for batch in (piece for whole in batches for piece in sliced(whole, 2)):
            sids, sizes, prefixes = [], [], []
            if len(seen) > _MAX_SEEN:
                seen.clear()
            for text in batch.column(2).to_pylist():
                p = shingler.prints(text)
                n, sid = len(p), set_print(p)
                sids.append(sid)
                sizes.append(n)
                if not n or sid in seen:
                    prefixes.append(p[:0])
                    continue
                seen.add(sid)
                if len(last):
                    hot = last[np.minimum(np.searchsorted(last, p), len(last) - 1)] == p
                    p = np.concatenate([p[~hot], p[hot]])
                prefixes.append(p[: n - (percent * n + 99) // 100 + 1].copy())
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U), *prefixes]).view(np.int64)))],
                names=["doc_id", "key", "sid", "n", "prefix"])

    return texts.mapInArrow(run, "doc_id long, key long, sid long, n long, prefix array<long>")


class Join:
    """Links between the sets of ``indexed``; sets are compared on their whole shingles."""

    def __init__(self, texts: DataFrame, indexed: DataFrame, length: int, percent: int):
        self.texts, self.indexed, self.length, self.percent = texts, indexed, length, percent
        self.edges: list[DataFrame] = []
        self.tested: list[DataFrame] = []

    def size_fits(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent)

    def shared_needed(self, a: Column, b: Column) -> Column:
        """Prefix shingles that two sets of these sizes share at least if they are similar enough.

        They have at least ``both`` shingles in common, so a set lacks at most its
        size less that; the rest of the earlier-ending prefix is shared.
        """
        both = F.ceil((a + b) * self.percent / (100 + self.percent) - 1e-9)
        prefix = lambda n: n - F.floor((n * self.percent + 99) / 100) + 1
        return F.least(prefix(a) - (a - both), prefix(b) - (b - both))

    def sets(self, wanted: DataFrame) -> DataFrame | None:
        """(sid, prints): the whole shingles of the ``wanted`` sets, read from one text each; null when there is none."""
        keys = written(self.indexed.select("sid", "key").join(wanted, "sid").groupBy("sid").agg(F.min("key").alias("key"))
                       .select("key").distinct(), "keys")
        n = keys.count()
        if not n:
            discard(keys)
            return None
        blocks, n_blocks = bloom_blocks(keys, "key", n)
        rows = may_contain(self.texts.select("key", "text"), "key", blocks, n_blocks, "maybe").where("maybe").select("key", "text")
        rows = rows.join(keys, "key", "left_semi").select("text")
        length = self.length

        def sets(batches):
            shingler = Shingler(length)
            for batch in (piece for whole in batches for piece in sliced(whole, 0)):
                prints = [shingler.prints(x) for x in batch.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_print(p) for p in prints], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U), *prints]).view(np.int64)))],
                    names=["sid", "prints"])

        found = written(rows.mapInArrow(sets, "sid long, prints array<long>").groupBy("sid").agg(F.first("prints").alias("prints")), "sets")
        discard(keys)
        return found

    def link(self, pairs: DataFrame, found: DataFrame | None = None) -> None:
        """Compare pairs (a, b) of sets and keep those similar enough as edges; ``found`` has the sets if they are there."""
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        self.tested.append(pairs)
        own = None
        if found is None:
            wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
            own = found = self.sets(wanted)
            if own is None:
                return
        percent = self.percent

        def rows_of(lists):
            ends, values = lists.offsets.to_pylist(), lists.values.to_numpy()
            return [values[lo:hi] for lo, hi in zip(ends, ends[1:])]

        def compare(batches):
            for batch in batches:
                keep = []
                for x, y in zip(rows_of(batch.column(2)), rows_of(batch.column(3))):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = (pairs.join(found.select(F.col("sid").alias("a"), F.col("prints").alias("x")), "a")
                  .join(found.select(F.col("sid").alias("b"), F.col("prints").alias("y")), "b").select("a", "b", "x", "y"))
        self.edges.append(written(joined.mapInArrow(compare, "a long, b long"), "links"))
        if own is not None:
            discard(own)

    def met_first(self) -> Column:
        """Whether a shingle at places pos_x and pos_y can be the first that two linked sets share.

        What comes before it in one set is not in the other, and all but ``both`` shingles of a set may be so.
        """
        both = F.ceil((F.col("n_x") + F.col("n_y")) * self.percent / (100 + self.percent) - 1e-9)
        return (F.col("pos_x") <= F.col("n_x") - both) & (F.col("pos_y") <= F.col("n_y") - both)

    def sparse_pairs(self, unsettled: DataFrame) -> DataFrame:
        """Pairs (a, b) that may link, at least one of them sparse; ``unsettled`` has (token, sid, n, pos, u, component, dense).

        A sparse set has few of its prefix shingles in these lists, so that it can link only with sets of other sizes:
        their shared shingles are few, and are counted.
        """
        x, y = (unsettled.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("sid", "n", "pos", "u", "component", "dense")]) for k in "xy")
        need = self.shared_needed(F.col("n_x"), F.col("n_y"))
        met = x.where(~F.col("dense_x")).join(y, "token").where(
            (F.col("component_x") != F.col("component_y")) & (F.col("dense_y") | (F.col("sid_x") < F.col("sid_y")))
            & self.size_fits(F.col("n_x"), F.col("n_y")) & (F.least("u_x", "u_y") >= need))
        met = met.groupBy("sid_x", "sid_y", "n_x", "n_y").agg(F.count("*").alias("c"), F.max(self.met_first()).alias("first"))
        return met.where(F.col("first") & (F.col("c") >= need)).select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b"))

    def link_groups(self, members: DataFrame, more: DataFrame | None = None) -> None:
        """Join the components of each group's sets wherever two of its sets link; ``members`` has (main, sid, n, component).

        Pairs (a, b) of ``more`` are compared with what is left in the groups.

        A set's difference d holds the shingles that it or its group's centre has,
        but not both. Two sets differ in |dx| + |dy| less twice what dx and dy share, and link if
        that is at most (100 - percent) / (100 + percent) of their sizes' sum. So with
        w = (100 + percent) |d| - (100 - percent) n they link for certain if wx + wy <= 0, in which case both
        link with the set of the least w; else if 2 (100 + percent) of what they share reaches wx + wy.
        """
        p = self.percent
        wanted = members.select("sid") if more is None else members.select("sid").unionAll(more.select("a")).unionAll(more.select("b"))
        whole = self.sets(wanted.distinct())
        if whole is None:
            return
        rows = members.join(whole, "sid")
        size = members.groupBy("main").agg(F.count("*").alias("size"))
        held = rows.select("main", F.explode("prints").alias("token")).groupBy("main", "token").agg(F.count("*").alias("c"))
        centre = held.join(size, "main").where("2 * c > size").groupBy("main").agg(F.collect_list("token").alias("centre"))
        none = F.array().cast("array<long>")
        rows = rows.join(centre, "main", "left").withColumn("centre", F.coalesce("centre", none))
        d = F.concat(F.array_except("prints", "centre"), F.array_except("centre", "prints"))
        diffs = written(rows.select("main", "sid", "n", "component", d.alias("d")).withColumn(
            "w", (100 + p) * F.size("d") - (100 - p) * F.col("n")), "differences")

        near = diffs.groupBy("main").agg(F.min(F.struct("w", "sid", "component")).alias("near"))
        diffs_near = diffs.join(near, "main").withColumn("star", F.col("w") + F.col("near.w") <= 0)
        self.edges.append(written(diffs_near.where(F.col("star") & (F.col("sid") != F.col("near.sid"))).select(
            F.least("sid", "near.sid").alias("a"), F.greatest("sid", "near.sid").alias("b")), "links"))

        # the others: shingles of differences that two sets of a group have, the rarest first, as many as a link must meet
        tokens = diffs_near.select("main", "sid", "n", "w", F.col("near.w").alias("w0"), F.size("d").alias("nd"), F.when(F.col("star"), F.col("near.component")).otherwise(
            F.col("component")).alias("component"), F.explode("d").alias("token"))
        often = tokens.groupBy("main", "token").agg(F.count("*").alias("m")).where("m > 1")
        least = F.greatest(F.lit(1), F.col("nd") - F.floor(F.col("n") * (100 - p) / p + 1e-9), F.ceil((F.col("w") + F.col("w0")) / (2 * (100 + p)) - 1e-9))
        kept = (tokens.join(often, ["main", "token"]).groupBy("main", "sid", "n", "w", "w0", "nd", "component")
                .agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("t")).withColumn("h", F.size("t")).where(F.col("h") >= least))
        kept = written(kept.select("main", "sid", "n", "w", "component", "h", F.explode(F.slice("t", F.lit(1), (F.col("h") - least + 1).cast("int"))).alias("t"))
                       .select("main", "sid", "n", "w", "component", "h", F.col("t.token").alias("token")), "parts")
        x = kept.where("component <> main").select("main", "token", *[F.col(c).alias(f"{c}_x") for c in ("sid", "n", "w", "component", "h")])
        y = kept.select("main", "token", *[F.col(c).alias(f"{c}_y") for c in ("sid", "n", "w", "component", "h")])
        rest = x.join(y, ["main", "token"]).where(
            (F.col("component_x") != F.col("component_y")) & ((F.col("component_y") == F.col("main")) | (F.col("sid_x") < F.col("sid_y")))
            & self.size_fits(F.col("n_x"), F.col("n_y")) & (F.col("w_x") + F.col("w_y") > 0)
            & (2 * (100 + p) * F.least("h_x", "h_y") >= F.col("w_x") + F.col("w_y")))
        rest = rest.select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b"))
        rest = (rest if more is None else rest.unionAll(more)).distinct()
        for done in self.tested:
            rest = rest.join(done, ["a", "b"], "left_anti")
        self.link(rest, whole)
        discard(whole, diffs, kept)

    def all_edges(self) -> DataFrame | None:
        out = None
        for x in self.edges:
            out = x if out is None else out.unionAll(x)
        return out


def link_sets(texts: DataFrame, indexed: DataFrame, length: int, percent: int, short: int, leaders: int) -> DataFrame | None:
    """(node, component) of the sets with links; null when there is none."""
    join = Join(texts, indexed, length, percent)
    postings = indexed.select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("sid", "token", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    # one shuffle by shingle serves the lists' sizes and their rows
    of = Window.partitionBy("token")
    lists = written(postings.select("*", F.count("*").over(of).alias("m"), F.min("sid").over(of).alias("lo"), F.max("sid").over(of).alias("hi"))
                    .where("lo < hi").groupBy("token", "sid").agg(F.first("at").alias("at"), F.first("m").alias("m"))
                    .select("token", "sid", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("pos"), "m"), "lists")
    few, many = lists.where(F.col("m") <= short), lists.where(F.col("m") > short)
    in_long = many.groupBy("sid").agg(F.count("*").alias("h"))
    many = many.join(in_long, "sid")

    a, b = few.select("token", F.col("sid").alias("a"), F.col("n").alias("na")), few.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"))
    met = (a.join(b, "token").where((F.col("a") < F.col("b")) & join.size_fits(F.col("na"), F.col("nb")))
           .groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")))
    met = (met.join(in_long.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a", "left")
           .join(in_long.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b", "left"))
    unseen = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    met = met.where(F.col("c") + unseen >= join.shared_needed(F.col("na"), F.col("nb"))).select("a", "b")

    # Pairs that meet in short lists are settled above. All others share their prefix shingles in long lists alone, so
    # both sets have as many there as a pair must share.
    def may_link(n, h, other_n, other_h) -> Column:
        return join.size_fits(n, other_n) & (F.least(h, other_h) >= join.shared_needed(n, other_n))

    # long lists: every set with the leaders of two of its lists; which ones only changes what is left for the last step
    best = many.groupBy("token").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "sid").alias("x"), F.col("sid"), F.col("n"), F.col("h"))).alias(f"l{i}")
                                       for i in range(leaders)])
    led = best.select("token", F.explode(F.array_distinct(F.transform(F.array(*[f"l{i}" for i in range(leaders)]), lambda x: F.struct(
        x["sid"].alias("sid"), x["n"].alias("n"), x["h"].alias("h"))))).alias("l")).select(
        "token", F.col("l.sid").alias("y"), F.col("l.n").alias("ny"), F.col("l.h").alias("hy"))
    two = many.groupBy("sid", "n", "h").agg(F.min("token").alias("t0"), F.max("token").alias("t1")).select(
        "sid", "n", "h", F.explode(F.array_distinct(F.array("t0", "t1"))).alias("token"))
    led = two.join(led, "token").where((F.col("sid") != F.col("y")) & may_link(F.col("n"), F.col("h"), F.col("ny"), F.col("hy")))
    join.link(met.unionAll(led.select(F.least("sid", "y").alias("a"), F.greatest("sid", "y").alias("b"))))
    label = components(join.all_edges()) if join.edges else None

    # lists not yet of one component: pairs in them share their prefix shingles there alone. Sets that have many are
    # grouped: a group is the sets of all those lists with one main component. The others' pairs are counted.
    placed = many.withColumn("component", F.col("sid")) if label is None else (
        many.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    unsettled = placed.join(mixed, "token").select("token", "sid", "n", "pos", "component")
    unsettled = unsettled.join(unsettled.groupBy("sid").agg(F.count("*").alias("u")), "sid")
    unsettled = written(unsettled.withColumn("dense", F.col("u") >= join.shared_needed(F.col("n"), F.col("n"))), "unsettled")
    discard(lists)
    if unsettled.isEmpty():
        discard(unsettled, *join.tested)
        return label
    more = written(join.sparse_pairs(unsettled), "sparse")
    per = unsettled.where("dense").groupBy("token", "component").agg(F.count("*").alias("c"))
    main = per.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("parts"))
    members = written(unsettled.where("dense").join(main.where("parts > 1"), "token").groupBy("main", "sid").agg(
        F.first("n").alias("n"), F.first("component").alias("component")), "members")
    join.link_groups(members, more)
    discard(unsettled, more, members, *join.tested)
    return components(join.all_edges()) if join.edges else None


def similar_documents(docs: DataFrame, length: int = 5, percent: int = 80, frequent: int = 16, short: int = 64,
                      leaders: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Sets of distinct shingles of ``length`` words link when their intersection
    is at least ``percent`` of their union. The component is the smallest id
    that links reach. A text with fewer words is one shingle; a null text, or
    one without a word, has the empty set and is linked with nothing. Rows of
    one text share a component. Null ids stay null and count for no component;
    repeated ids stay repeated. ``frequent``, ``short`` and
    ``leaders`` change the work, never the result. What the result reads is in its ``tables``, to be
    discarded once it is written elsewhere.
    """
    texts = _texts(docs, id_col, text_col)
    indexed = written(index_sets(texts, frequent_shingles(texts, length, frequent), length, percent), "indexed")
    label = link_sets(texts, indexed, length, percent, short, leaders)
    rows = indexed.select("doc_id", "sid", F.col("n").alias("n_shingles"))
    some, none = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    some = (some.withColumn("component", F.col("sid")) if label is None else
            some.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = some.join(least, "component").select("doc_id", "n_shingles", "component_id").unionAll(
        none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out.tables = [indexed]
    return out

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, ngram_join
from quillspark.llm.components import components

from .fixtures import SCHEMA, documents, stable

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(spark, tmp_path):
    docs = stable(spark, tmp_path, documents(spark))
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    got = exact_dedup.exact_dedup(docs, "doc_id", exact_dedup.normal_text(F.col("text")), ["doc_id", "text"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    kept = Counter()
    for r in got:
        same = groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        assert r.group_size == len(same)
        assert r.keep_id == min((i for i in same if i is not None), default=None)
        kept[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    empty = stable(spark, tmp_path / "e", spark.createDataFrame([], SCHEMA))
    assert exact_dedup.exact_dedup(empty, "doc_id", F.col("text"), ["doc_id"]).count() == 0


def brute(rows, n, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r)
    want = Counter()
    for group in out.values():
        least = min((r.doc_id for r in group if r.doc_id is not None), default=None)
        want.update((r.doc_id, least, len(sets[next(k for k, x in enumerate(rows) if x is r)])) for r in group)
    return want, len(out)


@pytest.mark.parametrize(("n", "percent", "room"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 50, 600)])
def test_ngram_groups_against_brute_force(spark, tmp_path, n, percent, room):
    docs = stable(spark, tmp_path, documents(spark))
    want, groups = brute(docs.collect(), n, percent)
    got = ngram_join.ngram_groups(docs, "doc_id", n=n, percent=percent, block_shingles=room).collect()
    assert Counter((r.doc_id, r.component, r.n_shingles) for r in got) == want
    assert sum(r.stays for r in got) == groups


def test_large_blocks_are_searched_in_bounded_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    words, texts = [f"w{k}" for k in range(60)], []
    for i in range(150):  # copies that drift away from the first
        words[rng.integers(60)] = f"d{i}"
        texts.append(" ".join(words))
    docs = stable(spark, tmp_path, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))
    room, cells, search = 900, [], ngram_join._search

    def watched(rows, n, percent):
        size = F.size(F.split("text", " ")) * F.when(F.col("index") | F.col("query"), 1)
        cells.extend(r.s for r in rows.groupBy("block", "part").agg(F.sum(size).alias("s")).collect())
        return search(rows, n, percent)

    monkeypatch.setattr(ngram_join, "_search", watched)
    got = ngram_join.ngram_groups(docs, "doc_id", n=3, percent=80, block_shingles=room).collect()
    want, _ = brute(docs.collect(), 3, 80)
    assert Counter((r.doc_id, r.component, r.n_shingles) for r in got) == want
    assert len(cells) > 20 and max(cells) <= 4 * room


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sign = ngram_join.Signatures(percent)
    for size in range(1, 75):
        for _ in range(40):
            a = np.unique(draw(size))
            b = np.union1d(a[rng.random(size) > rng.choice((0.05, 0.15, 0.3))], draw(rng.integers(0, 2 + size // 4)))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert np.intersect1d(sign(a), sign(b)).size


def test_short_unlinked_sets_share_no_signature():
    rng = np.random.default_rng(8)
    sign = ngram_join.Signatures(80)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(2, 40)).astype(np.uint64)) for _ in range(3000)]
    assert max(Counter(x for s in sets for x in np.unique(sign(s)).tolist()).values()) == 1


def test_ngram_groups_of_nothing(spark, tmp_path):
    assert ngram_join.ngram_groups(stable(spark, tmp_path, spark.createDataFrame([], SCHEMA)), "doc_id").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_skip_against_counting():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lists = [sorted(rng.choice(40, rng.integers(1, 20), replace=False).tolist()) for _ in range(rng.integers(1, 9))]
        need = int(rng.integers(1, len(lists) + 2))
        want = Counter(x for one in lists for x in one)
        docs, counts = ngram_join.merge_skip(lists, need)
        assert dict(zip(docs, counts, strict=True)) == {d: n for d, n in want.items() if n >= need}


def test_an_index_holds_its_members_alone():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(len(base)) < 0.02, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(120)]
    index = ngram_join.Index(sets, list(range(0, 120, 3)))
    assert index.size == 40 and set(index.docs.tolist()) == set(range(0, 120, 3))
    found = index.linked(sets[1], 80)
    assert set(found.tolist()) == {d for d in range(0, 120, 3) if 100 * len(np.intersect1d(sets[1], sets[d])) >= 80 * len(np.union1d(sets[1], sets[d]))}
    index.leave(np.arange(0, 90, 3))  # lists are made anew
    assert set(index.docs.tolist()) == set(range(90, 120, 3))
    assert set(index.linked(sets[1], 80).tolist()) == set(found[found >= 90].tolist())


def test_a_group_of_near_copies_is_searched_once():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(len(base)) < 0.005, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(400)]
    links = ngram_join.block_links(list(range(400)), sets, 80)
    assert len(links) == 399 and len({b for _, b in links}) == 399


def test_an_id_column_of_any_name(spark, tmp_path):
    docs = stable(spark, tmp_path, documents(spark).select(F.col("doc_id").alias("Component"), "text", F.lit(1).alias("row")))
    got = ngram_join.ngram_groups(docs, "Component")
    assert got.columns == ["row", "Component", "n_shingles", "component_", "stays"] and got.count() == docs.count()


def test_op2_as_the_contract_says(spark, tmp_path):
    docs = stable(spark, tmp_path, documents(spark))
    want, _ = brute(docs.collect(), 3, 90)
    got = ngram_join.op2_ngram_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter((r.doc_id, r.component_id, r.n_shingles) for r in got.collect()) == want


@pytest.mark.parametrize("changing", [False, True])
def test_rows_don_t_depend_on_the_splits(spark, tmp_path, monkeypatch, changing):
    """The splits of a scan follow the cores that a cluster has at that moment."""
    from pyspark.sql import DataFrame

    docs = documents(spark)
    for k in range(3):
        docs.filter(F.xxhash64("text") % 3 == k if k else F.coalesce(F.xxhash64("text") % 3, F.lit(0)).isin(0, -1, -2)).coalesce(1).write.option("parquet.block.size", 2000).mode("append").parquet(str(tmp_path / "d.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    text = exact_dedup.normal_text(F.col("text"))
    runs = {
        "dedup": lambda: exact_dedup.exact_dedup(docs, "doc_id", text, ["doc_id", "text"]),
        "join": lambda: ngram_join.ngram_groups(docs, "doc_id", n=3, percent=50, block_shingles=600),
    }
    sizes, keys = iter(range(10**9)), ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def turn() -> None:
        k = next(sizes)
        for key, value in zip(keys, ((2, 8, 16, 3)[k % 4], (500, 10_000, 3000, 10**7)[k % 4], 1), strict=True):
            spark.conf.set(key, value)

    want = {name: Counter(map(tuple, run().collect())) for name, run in runs.items()}
    try:
        if changing:  # at each action
            write = spark.range(1).write.__class__.parquet
            monkeypatch.setattr(spark.range(1).write.__class__, "parquet", lambda self, *a, **k: (turn(), write(self, *a, **k))[1])
            for name in ("collect", "count", "first", "isEmpty"):
                monkeypatch.setattr(type(docs), name, lambda self, *a, f=getattr(type(docs), name), **k: (turn(), f(self, *a, **k))[1])
        turn()
        got = {}
        for name, run in runs.items():
            made = run()
            turn()
            got[name] = Counter(map(tuple, made.collect()))
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == want and isinstance(docs, DataFrame)


def test_bucket_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 15, 40, 64, 65, 100, 130, 300, 1000, 5000)]
    for s in list(sets):
        for share in (0.5, 0.8, 0.9, 0.97, 1.0):
            kept = rng.random(len(s)) < share
            sets.append(np.unique(np.concatenate([s[kept], rng.integers(0, 2**63, int((~kept).sum() * rng.random())).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    ids = (100 + rng.permutation(len(sets))).tolist()
    for percent in (50, 80, 90):
        forest = ngram_join.possible_links(ids, [len(s) for s in sets], [ngram_join.bucket_counts(s) for s in sets], percent)
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in forest:
            assert find(a) != find(b)
            root[find(a)] = find(b)
        for i, a in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                    assert find(ids[i]) == find(ids[j])
        assert percent < 80 or len({find(i) for i in ids}) >= 10  # sets of other origins stay apart


@pytest.mark.parametrize("cell", [4096, 3])
def test_blocks_that_passages_chain_fall_apart(spark, tmp_path, monkeypatch, cell):
    """Documents that share passages, each with a few others, are one block by rare shingles."""
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell)
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(40)]
    texts = [" ".join(rng.choice(passages, 6, replace=False)) for _ in range(120)]
    texts += [t.replace("w3", "x3", 1) for t in texts[:30]] + [t + " end" for t in texts[10:20]] + [None, "", "short"]
    docs = stable(spark, tmp_path, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))
    asked = []
    kept = ngram_join._possible
    monkeypatch.setattr(ngram_join, "_possible", lambda *a: (asked.append(1), kept(*a))[1])
    want, groups = brute(docs.collect(), 5, 80)
    got = ngram_join.ngram_groups(docs, "doc_id", n=5, percent=80, block_shingles=500).collect()
    assert Counter((r.doc_id, r.component, r.n_shingles) for r in got) == want and asked and sum(r.stays for r in got) == groups


def test_what_is_counted_grows_with_the_table(spark, tmp_path, monkeypatch):
    """Passages chain more and more documents to one block; the shingles that are counted are not suddenly many
    where it gets large, and blocks of documents that their counts keep apart are not searched."""
    passages = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(4)]
    counted, searched, prefixes, search = [], [], ngram_join._prefixes, ngram_join._search
    monkeypatch.setattr(ngram_join, "_prefixes", lambda *a: (counted.append(a[3]), prefixes(*a))[1])
    monkeypatch.setattr(ngram_join, "_search", lambda rows, n, percent: (searched.append(rows.count()), search(rows, n, percent))[1])
    made = {}
    for size in (60, 300):
        rng = np.random.default_rng(8)
        texts = [" ".join([*(f"u{i}w{j}" for j in range(30)), *rng.choice(passages, 2, replace=False)]) for i in range(size)]
        texts += [t.replace("w3 ", "x3 ", 1) for t in texts[: size // 10]]
        docs = stable(spark, tmp_path / str(size), spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))
        counted.clear()
        searched.clear()
        got = ngram_join.ngram_groups(docs, "doc_id", n=5, percent=80, block_shingles=10_000).collect()
        want, _ = brute(docs.collect(), 5, 80)
        assert Counter((r.doc_id, r.component, r.n_shingles) for r in got) == want
        made[size] = sum(counted)
        assert sum(searched) <= size // 2
    assert 0 < made[300] <= 12 * made[60]


def test_operators_in_threads_keep_their_tables(spark, tmp_path):
    """What one operator deletes at its end isn't what another has stored."""
    from threading import Thread

    docs = stable(spark, tmp_path, documents(spark))
    want, _ = brute(docs.collect(), 3, 90)
    got = {}

    def run(k: int) -> None:
        found = ngram_join.ngram_groups(docs, "doc_id", n=3, percent=90).collect()
        got[k] = Counter((r.doc_id, r.component, r.n_shingles) for r in found)

    threads = [Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == dict.fromkeys(range(3), want)

"""The pipeline's near-duplicate stage: links by five-word shingles, against brute force."""

import random
from itertools import combinations

import corpus_pipeline
from allelix.llm import shingles, simhash


def _similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def _classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_stage_drops_moderate_near_copies(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(150, 400))]
        texts += [" ".join(words), _edited(rng, words, len(words) // 60), _edited(rng, words, len(words) // 10), "  ".join(words).upper()]
    texts += ["one two", "One  two", "one three", "one two one two one two one two one two", "one two one two one two", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = {(i, j) for i, j in combinations(range(len(texts) - 2), 2) if _similarity(texts[i], texts[j]) >= 0.8}
    sketched = shingles.sketches(df)
    name = {r["doc_id"]: r["name"] for r in sketched.collect()}
    links = {tuple(r) for r in shingles.similar_pairs(df, sketched).collect()}
    real = {tuple(sorted((name[i], name[j]))) for i, j in want}
    assert links <= real and len(links) > 20 and name[105] is None
    at = {}
    ids = [at.setdefault(name[i], i) for i in range(len(texts) - 2)]
    got = _classes(len(texts) - 2, [(at[a], at[b]) for a, b in links] + list(enumerate(ids)))
    assert got == _classes(len(texts) - 2, want)
    bits = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert any(bits[i] != bits[j] for i, j in want)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert not any(i in kept and j in kept for i, j in want) and {0, 2, 100, 102} <= kept


def test_large_groups_cost_a_few_pairs_for_each_text(spark, monkeypatch):
    """Classes of a chain, of a large group and of its outliers, by brute force, while what leaves a task stays far below all pairs."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = [_edited(rng, base, 2) for _ in range(200)] + [_edited(rng, base, 6) for _ in range(120)] + [_edited(rng, base, 15) for _ in range(60)]
    chain = list(base) + ["end"] * 5
    for k in range(60):  # each like the one before, the ends unlike
        chain = [f"c{k}x{j}" if j // 5 == k else w for j, w in enumerate(chain)]
        texts.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = shingles.sketches(df)
    name = [r["name"] for r in sorted(sketched.collect())]
    at = {n: i for i, n in enumerate(name)}
    want = [(i, j) for i, j in combinations(range(len(texts)), 2) if _similarity(texts[i], texts[j]) >= 0.8]
    compared, check = [], shingles._similar
    monkeypatch.setattr(shingles, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or check(pairs, *rest))
    for part in (2048, 9):
        monkeypatch.setattr(shingles, "PART", part)
        links = [tuple(r) for r in shingles.similar_pairs(df, sketched).collect()]
        assert {tuple(sorted((at[a], at[b]))) for a, b in links} <= set(want)
        assert _classes(len(texts), [(at[a], at[b]) for a, b in links]) == _classes(len(texts), want)
        assert len(want) > 15_000 and compared.pop() + len(links) < len(want) / 2


def test_stage_judges_rows_without_ids_and_repeated_ids(spark):
    rng = random.Random(5)
    words = [[f"v{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(4)]
    t = [" ".join(w) for w in words]
    rows = [(None, t[0]), (None, t[0]), (None, _edited(rng, words[0], 2)), (5, t[1]), (5, t[2]), (7, t[1]), (None, t[2]), (9, t[3]), (9, t[3]), (1, ""), (None, None), (2, " ")]
    df = spark.createDataFrame([(i, x, k, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, key int, row int")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    kept = [tuple(r) for r in kept.collect()]
    assert sorted(r[3] for r in kept if r[0] is not None) in ([3, 4, 7, 9], [3, 4, 8, 9])
    assert len([r for r in kept if r[0] is None]) == 1 and all(r[3] < 3 for r in kept if r[0] is None)
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").collect() == []

"""Operators over whole tables against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import decontaminate, graph, jaccard, katz
from tests.llm import cases


def plain_overlaps(rows, items):
    windows, widths = defaultdict(set), set()
    for item, text in items:
        words = cases.alnum_words(text)
        wide = min(10, len(words))
        if wide:
            widths.add(wide)
            for k in range(len(words) - wide + 1):
                windows[tuple(words[k:k + wide])].add("null" if item is None else str(item))
    found = []
    for doc, text, *_ in rows:
        words, hit, met = cases.alnum_words(text), set(), set()
        for wide in widths:
            for k in range(len(words) - wide + 1):
                if owners := windows.get(tuple(words[k:k + wide])):
                    met |= owners
                    hit |= set(range(k, k + wide))
        found.append((doc, len(words), len(hit), ",".join(sorted(met))))
    return found


@pytest.fixture(scope="module")
def contaminated():
    items = [(1, cases.prose(900, 40)), (2, cases.prose(901, 10)), (3, "just four words here"), (4, None), (5, "..."), (None, cases.prose(902, 12)), (12, cases.prose(900, 40)), (13, "Word")]
    words = cases.prose(900, 40).split()
    rows = [
        *cases.ROWS,
        (40, " ".join([*cases.prose(40, 30).split(), *words[5:15], "gap", *words[16:30]]), "en"),
        (41, " ".join(words[5:14]), "en"),
        (42, cases.prose(901, 10).upper() + " just FOUR words, here", "en"),
        (43, f"{cases.prose(902, 12)} {cases.prose(902, 12)}", "en"),
        (44, "a word", "en"),
        (45, " ".join(words[3:13] * 3), "en"),
    ]
    return rows, items


def test_overlaps_equal_the_plain_version(spark, contaminated):
    rows, items = contaminated
    docs = cases.docs(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    found = decontaminate.find_overlaps(docs, benchmark)
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect()]
    assert cases.plain(got) == cases.plain(plain_overlaps(rows, items))
    assert found.filter("doc_id = 40").first().windows[0].at == 30
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    clean = [r for r, p in zip(rows, plain_overlaps(rows, items)) if not p[2]]
    assert cases.plain(left.select("doc_id", "text", "lang").collect()) == cases.plain(clean)


def test_overlaps_of_empty_tables(spark, contaminated):
    rows, items = contaminated
    docs, benchmark = cases.docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.find_overlaps(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_overlaps(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_winnowing_keeps_a_shared_hash_for_every_window(spark):
    words = F.split(F.lit(cases.prose(77, 60).lower()), " ")
    row = decontaminate.fingerprints(spark.range(1).select(words.alias("w")), "w", [], "all").first()
    for k in range(51):
        part = spark.range(1).select(F.slice(words, k + 1, F.lit(10)).alias("w"))
        if k % 10 == 0:
            assert set(decontaminate.fingerprints(part, "w", [], "p").first().p) <= set(row["all"])
    assert len(row["all"]) < 40


def test_overlaps_have_no_python_in_their_plan(spark, contaminated):
    rows, items = contaminated
    found = decontaminate.find_overlaps(cases.docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string").coalesce(1))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


def plain_groups(rows, percent=85):
    sets = []
    for _, text, *_ in rows:
        words = cases.solid_words(text)
        sets.append({tuple(words[k:k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return sets, list(groups.values())


@pytest.fixture(scope="module")
def copies():
    rows = list(cases.ROWS)
    for k in range(12):  # a group whose members are near the template, not all near each other
        rows.append((500 + k, edited_at(cases.prose(50, 100), k), "en"))
    rows.append((600, cases.prose(50, 100), "en"))
    for k in range(6):  # a chain: each next to the one before only
        rows.append((700 + k, cases.edited(rows[-1][1] if k else cases.prose(60, 300), k, 3), "en"))
    for k in range(40):
        rows.append((800 + k, cases.edited(cases.prose(70, 40), k, k % 3), "en"))
    rows += [(900 + k, " ".join(cases.prose(80, 12).split()[k % 2:]), "en") for k in range(4)]
    rows += [(950, "One two", "en"), (951, "one  TWO", "en"), (952, "one two three", "en"), (953, "a b c d", "en"), (954, "A b c d", "en")]
    rows += [(1000 + k, cases.prose(2000 + k, 30 + k), "en") for k in range(60)]
    return rows


def edited_at(text: str, k: int) -> str:
    words = text.split()
    words[8 * k % len(words)] = f"changed{k}"
    return " ".join(words)


def test_groups_equal_the_plain_version(spark, copies):
    sets, groups = plain_groups(copies)
    wanted = []
    for group in groups:
        ids = [copies[k][0] for k in group if copies[k][0] is not None]
        wanted += [(copies[k][0], len(sets[k]), min(ids) if ids else None) for k in group]
    docs = cases.docs(spark, copies, extra="entries int, node string, root int, size int, row_key int")
    got = [(r.doc_id, r["size"], r.component_id) for r in jaccard.similar_groups(docs).collect()]
    assert cases.plain(got) == cases.plain(wanted)
    assert max(map(len, groups)) >= 12
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    first = []
    for group in groups:
        best = min(group, key=lambda k: (copies[k][0] is None, copies[k][0] or 0))
        first.append(copies[best])
    assert cases.plain(kept.select("doc_id", "text", "lang").collect()) == cases.plain(first)


@pytest.mark.parametrize("tile", [3, 4096])
def test_all_pairs_left_are_compared_in_tiles(spark, copies, monkeypatch, tile):
    """Without a first round that merges anything, the second finds all links, whatever the size of its pieces."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    near = jaccard._near
    monkeypatch.setattr(jaccard, "_near", lambda pairs, maps, percent: near(pairs, maps, percent).limit(0))
    ids = [r[0] for r in copies if r[0] is not None and 500 <= r[0] < 953]
    rows = [r for r in copies if r[0] in ids]
    _, groups = plain_groups(rows)
    wanted = {(rows[k][0], min(rows[x][0] for x in g)) for g in groups for k in g}
    found = jaccard.similar_groups(cases.docs(spark, rows))
    buckets_of_two = {(r.doc_id, r.component_id) for r in found.collect()} ^ wanted
    assert len(buckets_of_two) <= 12  # pairs that meet in buckets of two only are left to the first round


def test_bitmaps_differ_in_no_more_bits_than_members():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 2**63, int(rnd.integers(1, 3000)), dtype=np.uint64))
        b = np.concatenate([a[int(rnd.integers(0, len(a))):], rnd.integers(0, 2**63, int(rnd.integers(0, 200)), dtype=np.uint64)])
        apart = np.bitwise_count((jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64)).sum()
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_groups_of_empty_tables(spark):
    docs = cases.docs(spark)
    assert jaccard.similar_groups(docs.limit(0)).count() == 0
    assert jaccard.keep_one(docs.filter("doc_id IN (3, 4, 5)")).count() == 3


@pytest.mark.parametrize("rows", [10, 10**6, 10**12])
def test_linked_sets_share_an_entry(rows):
    """Pairs at the very border of similarity, for layouts with and without one-deletion segments."""
    rnd, layout, tried = np.random.default_rng(5), jaccard.bands(rows), 0
    for _ in range(2_000):
        n = int(rnd.integers(6, 40 if rnd.random() < 0.5 else 400))
        a = rnd.integers(0, 2**63, n, dtype=np.uint64)
        apart = max(0, jaccard.most_apart(n, jaccard.largest_partner(n)) - int(rnd.integers(0, 2)))
        gone = int(rnd.integers(0, min(apart, n - 1) + 1))
        b = np.concatenate([a[gone:], rnd.integers(0, 2**63, apart - gone, dtype=np.uint64)])
        one, two = set(a.tolist()), set(b.tolist())
        if one != two and 100 * len(one & two) >= 85 * len(one | two):
            tried += 1
            assert set(jaccard.entries(np.unique(a), layout).tolist()) & set(jaccard.entries(np.unique(b), layout).tolist())
    assert tried > 500


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 5), (5, 4), (6, 6)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)]
    rows = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 100 for k in range(100, 161)} | {k: 200 for k in range(200, 260)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


class PlainKatz:
    """The same model over dictionaries."""

    def __init__(self, texts: list[str | None]) -> None:
        tokens = [[*cases.solid_words(t), None] for t in texts]
        self.counts = Counter(w for t in tokens for w in t)
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        self.own = {w for w in self.counts if w is not None}
        pairs = Counter(p for t in tokens for p in self.pairs(t))
        self.factors = katz.discounts(Counter(n for n in pairs.values() if n <= katz.DISCOUNTED + 1))
        classes = Counter({w: self.counts[w] for w in self.own})
        classes[None], other = self.counts[None], self.total - self.counts[None] - sum(classes.values())
        classes["<other>"] = other
        self.chance = {w: (n + 1) / (self.total + len(classes)) for w, n in classes.items()}
        self.spell = math.log10(other + self.distinct - len(self.own) - (self.counts[None] > 0) + 1)
        self.after: dict = defaultdict(dict)
        for (first, second), n in pairs.items():
            self.after[first][second] = n

    def of(self, word):
        return word if word is None or word in self.own else "<other>"

    def pairs(self, words):
        classes = ["<start>", *map(self.of, words)]
        return list(zip(classes, classes[1:]))

    def bigram(self, first, second) -> float:
        seen = self.after.get(first)
        if not seen:
            return self.chance[second]
        n = sum(seen.values())
        kept = {w: c * (self.factors[c] if c <= katz.DISCOUNTED else 1) for w, c in seen.items()}
        scale = n / sum(kept.values()) if len(seen) == len(self.chance) else 1 - 0.5 / n if sum(kept.values()) >= n else 1
        if second in kept:
            return kept[second] * scale / n
        return (1 - sum(kept.values()) * scale / n) / (1 - sum(self.chance[w] for w in seen)) * self.chance[second]

    def score(self, text):
        words = [*cases.solid_words(text), None]
        base = sum(math.log10((self.counts[w] + 1) / (self.total + self.distinct + 1)) for w in words)
        lm = sum(math.log10(self.bigram(*p)) for p in self.pairs(words))
        lm += sum(math.log10(self.counts[w] + 1) - self.spell for w in words if self.of(w) == "<other>")
        return len(words), sum(self.counts[w] > 0 for w in words), base, lm


def test_katz_hashes_different_words_once_a_lot(monkeypatch):
    texts = ["One two  one\tTWO é É", None, "", " \n", "two", "\x1cone\x85 \xa0", "two " * 500]
    words = [katz.words_of(t) for t in texts]
    digest = katz.xxhash.xxh3_64_intdigest
    want = [[digest(w) for w in own] + [int(katz.END_HASH)] for own in words]
    for together in (1, 4, 10_000):
        asked = []
        monkeypatch.setattr(katz, "WORDS_TOGETHER", together)
        monkeypatch.setattr(katz.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or digest(w))
        found, sizes = katz.hashed(texts)
        assert found.tolist() == [h for own in want for h in own] and sizes.tolist() == [len(own) for own in want]
    assert len(asked) == len({w for own in words for w in own})
    assert [len(a) for a in katz.hashed([])] == [0, 0]


@pytest.mark.parametrize(("share", "tokens", "places"), [(5e-5, 10**6, 10**5), (2.5e-3, 5000, 100), (0.25, 700, 10)])
def test_katz_equals_the_plain_version(spark, monkeypatch, share, tokens, places):
    monkeypatch.setattr(katz, "LOCAL_SHARE", share)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", tokens)
    monkeypatch.setattr(katz, "SPLIT_PLACES", places)
    monkeypatch.setattr(katz, "MERGE_AT", tokens)
    rows = cases.ROWS + [(100 + i, cases.prose(i, 60), "en") for i in range(30)]
    docs = cases.docs(spark, rows, extra="lm_score string, key int, row int, value int, n string")
    train = docs.filter("doc_id IS NULL OR doc_id % 3 <> 2")
    plain = PlainKatz([t for i, t, _ in rows if i is None or i % 3 != 2])
    model = katz.train(train)
    assert (model.tokens, model.distinct) == (plain.total, plain.distinct)
    scored = katz.score(docs, model).collect()
    assert len(scored) == len(rows)
    for row in scored:
        tokens, known, base, lm = plain.score(row.text)
        assert (row.lm_tokens, row.lm_known) == (tokens, known)
        assert row.lm_base == pytest.approx(base) and row.lm_score == pytest.approx(lm)


@pytest.mark.parametrize("local", [1e-6, 1e-3])
def test_katz_counts_bigrams_of_all_words(spark, monkeypatch, local):
    # Of more than 20,000 tokens each, so a word seen once is rare by any share.
    monkeypatch.setattr(katz, "LOCAL_SHARE", local)
    rows = cases.ROWS + [(100 + i, f"{cases.prose(i, 60)} rare{i // 3} pair{i // 3} end", "en") for i in range(30)]
    docs = cases.docs(spark, rows)
    plain = PlainKatz([t for i, t, _ in rows if i is None or i % 3 != 2])
    model = katz.train(docs.filter("doc_id IS NULL OR doc_id % 3 <> 2"))
    assert plain.total > 20_000 and plain.after["rare3"] == {"pair3": 2}
    for row in katz.score(docs, model).collect():
        tokens, known, base, lm = plain.score(row.text)
        assert (row.lm_tokens, row.lm_known) == (tokens, known)
        assert row.lm_base == pytest.approx(base) and row.lm_score == pytest.approx(lm)


def test_katz_chances_add_up_to_one():
    plain = PlainKatz([cases.prose(i, 80) for i in range(20)])
    for first in list(plain.after)[:50]:
        assert sum(plain.bigram(first, second) for second in plain.chance) == pytest.approx(1)


def test_katz_of_empty_tables(spark):
    docs = cases.docs(spark)
    model = katz.train(docs.limit(0))
    assert (model.tokens, model.distinct) == (0, 0)
    rows = katz.score(docs, model).collect()
    assert len(rows) == len(cases.ROWS) and all(r.lm_known == 0 and r.lm_base == 0 and math.isfinite(r.lm_score) for r in rows)
    assert katz.score(docs.limit(0), katz.train(docs)).count() == 0


def test_discounts_lie_between_zero_and_one():
    for counts in ({}, {1: 10}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 1, 6: 50}):
        assert all(0 < f <= 1 for f in katz.discounts(counts))


def test_pipeline_against_a_plain_version(spark, tmp_path, tokenizer_of_the_library):
    from tests.llm.test_text_operators import base_secrets, plain_counts

    item = cases.prose(900, 40)
    rows = [(i, cases.prose(i, 80), "en") for i in range(60)]
    rows += [(100 + i, cases.edited(cases.prose(3, 80), i, 1), "en") for i in range(3)]
    rows += [(200, f"{cases.prose(70, 60)} {item}", "en"), (201, "too short", "en"), (202, cases.prose(71, 60) + ' token = "0123456789abcdef0123456789"', "en"), (203, None, "en"), (61, cases.prose(61, 80), "en"), (61, cases.prose(61, 80), "en")]
    docs = cases.docs(spark, rows, extra=None)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [r for r in rows if not plain_counts(r[1])[5]]
    _, groups = plain_groups(good)
    kept = [good[min(g, key=lambda k: good[k][0])] for g in groups]
    kept = [r for r, p in zip(kept, plain_overlaps(kept, [(1, item)])) if not p[2]]
    wanted = []
    for doc, text, lang in kept:
        for _, start, end in reversed(base_secrets(text)[:1]):
            text = text[:start] + "[SECRET]" + text[end:]
        ids = tokenizer_of_the_library.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        wanted.append((doc, lang, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = [(r.doc_id, r.lang, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()]
    assert cases.plain(got) == cases.plain(wanted)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.withColumn("q_kept", F.lit(1)), str(tmp_path)).columns == [*df.columns, "q_kept"]


@pytest.fixture(scope="module")
def tokenizer_of_the_library():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_folds_follow_crc32(spark):
    from postloom.llm.rows import fold

    rows = spark.createDataFrame([(k,) for k in (None, 0, 1, 77, 10**12)], "doc_id bigint").select("doc_id", fold("doc_id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 for r in rows)

"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SPACE = "[^\x20\x09-\x0d]+"
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def make_texts():
    rng = random.Random(4)
    base = words(rng, 160)
    passage = words(rng, 75)
    out = [None, "", " ", "\n\n", "One", "x" * 1300, "ab " * 700, base, base, base + " tail", words(rng, 4000)]
    for i in range(14):
        edited = base.split()
        edited[rng.randrange(len(edited))] = f"edit{i}"
        out.append(" ".join(edited))
    for _ in range(6):
        out.append(words(rng, 60) + " " + passage + " " + words(rng, 50))
    for i in range(12):
        out.append(f"Shared Line  \n{words(rng, 30)}\n\tshared line\nUnique {i}.")
    out += ["Kelvin K İ cc by stands; General PUBLIC\nlicense, all rights reserved", "Licensed under the Apache License, Version 2.0.\nother", "cc by cc by", "a,b,c!! ###"]
    return out


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    from sparsewright.plans.session import ship

    ship(spark)
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keys string, n_words double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("limit", [40_000, 3])
def test_suffix_dedup(docs, texts, empty, limit):
    from sparsewright.llm.suffix_dedup import LENGTH, PASSAGE, STRING, removals

    split = [re.findall(SPACE, t or "") for t in texts]
    holders = {}
    for n in (STRING, PASSAGE):
        for i, w in enumerate(split):
            for k in range(len(w) - n + 1):
                holders.setdefault(tuple(w[k : k + n]), set()).add(i)
    some = lambda w, n: any(len(holders[tuple(w[k : k + n])]) > 1 for k in range(len(w) - n + 1))
    seen = Counter(b[i : i + LENGTH] for t in texts for b in [(t or "").encode()] for i in range(len(b) - LENGTH + 1))
    got = by_id(removals(docs, limit))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1):
            if seen[b[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, sha(kept))
        assert some(split[i], PASSAGE) <= (got[i].n_shared_strings > 0) <= some(split[i], STRING)
    assert any(r.n_removed for r in got.values())
    assert removals(empty, limit).count() == 0


def test_repeated_rows_are_repeats(spark, docs, texts):
    from sparsewright.llm.suffix_dedup import removals

    long = texts[10]
    huge = " ".join(f"w{i}" for i in range(60_000))  # a slice of its own
    rows = by_id(removals(spark.createDataFrame([(1, huge, "x"), (2, huge + " " + long, None), (3, long, "x")], "doc_id long, text string, chunk string")))
    assert [(r.n_removed, r.n_shared_strings > 100) for r in (rows[1], rows[3])] == [(len(huge), True), (len(long.encode()), True)]
    rows = removals(spark.createDataFrame([(1, long), (1, long), (None, "short")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in rows) == [(0, 5), (1, 0), (1, 0)]


def test_piece_codec(docs, texts, empty):
    import sentencepiece

    from sparsewright.llm import piece_codec

    path = piece_codec.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(piece_codec.digests(docs, path))
    spans = by_id(piece_codec.decode(piece_codec.encode(docs, path), path))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert got[i].decoded_sha256 == sha(lib.decode(ids).encode())
        assert got[i].n_covered == len((t or "").encode())
        assert spans[i].ids == ids and spans[i].decoded == lib.decode(ids) and spans[i].keys == "x"
        assert all(b <= e for b, e in zip(spans[i].begins, spans[i].ends))
    assert piece_codec.digests(empty, path).count() == 0


def test_segmentation_equals_the_library():
    from sparsewright.llm import piece_codec

    use = piece_codec.codec(piece_codec.read_model(piece_codec.default_model()))
    assert use.segment.usable
    rng = random.Random(9)
    alphabet = list(" ▁ab eé日本\t\n\r語xyz😀\x00\x01<s>ñß,.") + ["the", "ing", "   ", "\u200d", "ation"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["z" * 5000, "", " ", "x" * 400_000]
    use.segment.KEPT = 500  # forgets, and learns again
    for a in range(0, len(some), 100):
        part = some[a : a + 100]
        for t, (ids, decimal, back, align) in zip(part, use.pieces(part), strict=True):
            assert ids == use.model.encode(t) and decimal == ",".join(map(str, ids)) and back == use.decode(ids) == use.model.decode(ids)
            begin, end = use.spans(t, ids, align)
            assert (np.diff(begin) >= 0).all() and (not ids or (begin[0], end[-1]) == (0, len(t.encode())))


def test_frequent_runs_are_merged_once(monkeypatch):
    """Runs that every slice asks for outlive those of one slice."""
    from sparsewright.llm import piece_codec

    use = piece_codec.Codec(piece_codec.read_model(piece_codec.default_model()))
    use.segment.KEPT = 500
    merged, many = Counter(), use.segment.merge_many
    monkeypatch.setattr(use.segment, "merge_many", lambda runs: merged.update(runs) or many(runs))
    for k in range(20):
        part = [f"the rest ▁▁ of {k}x{j} the  rest " for j in range(60)] + ["", " "]
        rows = piece_codec._digest(use, part)
        for t, n, ids, back, covered in zip(part, *rows, strict=True):
            want = use.model.encode(t)
            assert (n, ids, back, covered) == (len(want), sha(",".join(map(str, want)).encode()), sha(use.model.decode(want).encode()), len(t.encode()))
    assert merged["▁the"] == merged["▁rest"] == 1


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_normaliser_follows_compiled_map(rule, collapse):
    import sentencepiece

    from sparsewright.llm.piece_codec import Normalizer

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=collapse)
    mine = Normalizer(lib.serialized_model_proto())
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", " ", "  ", "é", "ｱ", "ﬁ", "①", "　", "ß", "\t", "½", "か゛", "™", "​"]) for _ in range(rng.randint(0, 12)))
        made, align = mine(t.encode())
        assert made.decode() == lib.normalize(t)
        assert len(align) == len(made) + 1 and (np.diff(align) >= 0).all() and (not len(made) or align[-1] <= len(t.encode()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_and_reversal(docs, texts, empty, broadcast, monkeypatch):
    from sparsewright.llm import line_dedup
    from sparsewright.llm.line_dedup import LineStore

    if not broadcast:  # filters are met by shard, in several copies
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
        monkeypatch.setattr(line_dedup, "SALT_LINES", 3)

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    store = LineStore.build(docs)
    out = by_id(store.rewrite(docs))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < 10]
        assert (out[i].n_lines, out[i].n_dropped) == (len(lines), len(lines) - len(kept))
        assert (out[i].text or "") == "\n".join(kept)
    assert sum(r.n_dropped for r in out.values()) == 24
    # deleting three of the documents takes the line under the threshold; inserting them again brings it back
    few = docs.filter("text like 'Shared%'").limit(3).cache()
    less = store.delete(few)
    assert sum(r.n_dropped for r in less.rewrite(docs).collect()) == 0
    again = less.insert(few)
    assert sum(r.n_dropped for r in again.rewrite(docs).collect()) == 24
    assert {tuple(r) for r in again.counts.collect()} == {tuple(r) for r in store.counts.collect()}
    assert LineStore.build(empty).rewrite(empty).count() == 0


def test_cuckoo_filter():
    from sparsewright.llm.line_dedup import CuckooFilter, digest

    keys = [digest(str(i).encode()) for i in range(5000)]
    made = CuckooFilter.of(keys)
    both = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    assert made.probe(both).all()
    assert all(made.delete(k) for k in keys[:2500])
    assert made.probe(both[2500:]).all() and made.probe(both[:2500]).mean() < 0.01


def components_by_force(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def shingles(t):
    w = re.findall(SPACE, (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(docs, texts, empty):
    from sparsewright.llm.ngram_join import NgramJoin

    sets = [shingles(t) for t in texts]
    want = components_by_force(sets)
    got = by_id(NgramJoin(docs).components())
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, want)]
    assert NgramJoin(empty).components().count() == 0


def test_ngram_join_of_chains(spark):
    """Documents that drift apart by single edits, of all sizes: links hold between neighbours only."""
    from sparsewright.llm.ngram_join import NgramJoin

    rng = random.Random(9)
    texts = []
    for n in (4, 5, 6, 9, 14, 25, 40, 64, 90, 150, 260, 700):
        now = words(rng, n).split()
        for _ in range(12):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(max(1, n // 60)):
                now[rng.randrange(n)] = words(rng, 1)
            if rng.random() < 0.3:
                now.append(words(rng, 1))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(NgramJoin(df).components())
    assert [got[i].component_id for i in range(len(texts))] == components_by_force([shingles(t) for t in texts])


@pytest.mark.parametrize("few", [1, 3, 8])
def test_ngram_join_compares_members_of_few_and_many(spark, monkeypatch, few):
    """Groups of near copies and of texts just beyond the threshold, for all sizes of a key's group."""
    from sparsewright.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(8)
    some = []
    for size in (2, 3, 4, 7, 9, 20):
        base = words(rng, 90).split()
        for i in range(size):
            edited = list(base)
            for k in rng.sample(range(len(base)), rng.randint(0, 4)):
                edited[k] = f"edit{i}x{k}"
            some.append(" ".join(edited))
    rows = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(some)], "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in some]
    root = list(range(len(some)))
    for i in range(len(some)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = Counter(min((k for k in range(len(some)) if root[k] == root[i] and k != 5), default=None) for i in range(len(some)))
    assert Counter(r.component_id for r in ngram_join.NgramJoin(rows).components().collect()) == want
    assert 6 < len(want) < len(some)


@pytest.mark.parametrize("most", [64, 1 << 24])
def test_sieve(spark, monkeypatch, most):
    from sparsewright.llm import sieve

    monkeypatch.setattr(sieve, "MOST_BITS", most)
    rows = spark.createDataFrame([(None, "n")] + [(i * 7919 - 10**6, f"t{i}") for i in range(3000)] + [(0, "twice")], "doc_id long, __word string")
    asked = [None, *(i * 7919 - 10**6 for i in range(0, 3000, 20))]
    may, none = sieve.Sieve.of(spark.createDataFrame([(x,) for x in asked], "x long")).split(rows)
    assert may.columns == none.columns == rows.columns
    may, none = [tuple(r) for r in may.collect()], [tuple(r) for r in none.collect()]
    assert Counter(may + none) == Counter(map(tuple, rows.collect()))
    assert not {x for x, _ in none} & set(asked)
    assert most == 64 or len(may) < 600
    may, none = sieve.Sieve.of(spark.createDataFrame([], "x long")).split(rows)
    assert (may.count(), none.count()) == (0, rows.count())


@pytest.mark.parametrize("block_words", [1 << 20, 30])
def test_decontaminate(spark, docs, texts, empty, block_words):
    from sparsewright.llm.decontaminate import cut_words, find_spans

    rng = random.Random(3)
    items = [(0, " ".join(texts[7].split()[20:40])), (1, texts[26]), (2, "CC, by"), (3, ""), (4, None), (5, words(rng, 20)), (6, " ".join(texts[7].split()[35:50])), (7, "unique 3"), (7, "unique 3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = re.findall(ALNUM, (t or "").translate(LOW))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i)
    got = by_id(find_spans(docs, bench, block_words=block_words))
    plain = by_id(find_spans(docs, bench, block_words=block_words, cut=True))
    for i, t in enumerate(texts):
        w = re.findall(ALNUM, (t or "").translate(LOW))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in {len(p) for p in windows}:
                p = tuple(w[k : k + n])
                if len(p) == n and p in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[p]
        r = got[i]
        assert r.n_words == len(w)
        assert {x for b, e in zip(r.begins, r.ends) for x in range(b, e)} == hit
        assert all(e < b for e, b in zip(r.ends, r.begins[1:]))
        assert r.item_ids == sorted(map(str, found))
        assert plain[i].text == (cut_words(t, r.begins, r.ends) if r.begins else t)
    assert find_spans(empty, bench).count() == 0
    assert all(r.item_ids == [] for r in find_spans(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("block_words", [1 << 20, 5])
def test_decontaminate_keeps_rows_without_own_id(spark, block_words):
    from sparsewright.llm.decontaminate import find_spans

    bench = spark.createDataFrame([(0, "one two three"), (1, "four five six")], "item_id long, text string")
    rows = [(None, "say one two three now", 1), (None, "four five six", 2), (None, None, 3), (7, "a four five six b one two three c", 4), (7, "clean words", 5), (8, "one two three", 6), (8, "one two three", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = find_spans(docs, bench, window=3, block_words=block_words)
    assert found.columns == ["doc_id", "text", "n", "n_words", "begins", "ends", "item_ids"]
    got = sorted((r.n, r.doc_id, r.text, r.n_words, r.begins, r.ends, r.item_ids) for r in found.collect())
    want = [(5, [1], [4], ["0"]), (3, [0], [3], ["1"]), (0, [], [], []), (9, [1, 5], [4, 8], ["0", "1"]), (2, [], [], []), (3, [0], [3], ["0"]), (3, [0], [3], ["0"])]
    assert got == [(n, i, t, *w) for (i, t, n), w in zip(rows, want)]
    cut = find_spans(docs, bench, window=3, block_words=block_words, cut=True)
    assert sorted((r.n, r.text or "") for r in cut.collect()) == [(1, "say  now"), (2, ""), (3, ""), (4, "a  b  c"), (5, "clean words"), (6, ""), (6, "")]


def test_fm_index():
    from sparsewright.llm.decontaminate import FMIndex

    rng = np.random.default_rng(1)
    s = rng.integers(0, 5, 400)
    s[-1] = 0
    index = FMIndex(s, 4)
    pats = rng.integers(1, 5, (60, 3))
    low, high = index.search(pats)
    for p, a, b in zip(pats, low, high):
        want = [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def labelled_corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        t = words(rng, 50)
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            parts = t.split()
            parts[10], parts[30] = "grobian" + rng.choice(["", "s", "en"]), rng.choice(["lump", "schuft"])
            t = " ".join(parts)
        if not good:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, None))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (9_999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_toxicity(spark, docs, empty):
    from sparsewright.llm import toxicity

    corpus, labels = labelled_corpus(spark)
    model = toxicity.train(corpus, labels, "toxic", 3, 1)
    got = by_id(toxicity.score(corpus, model))
    out = [i for i in range(600) if held(i, 3, 1)]
    assert np.mean([(got[i].score >= 0.7) == (i % 4 == 0) for i in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(corpus, labels.limit(0), "toxic", 3, 1)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_factorization_learns_pairs():
    from sparsewright.llm.toxicity import fit, sigmoid

    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.unique(np.concatenate([[1] if a else [], [2] if b else [], rng.integers(10, 60, 5)]).astype(int)))
        y.append(float(a == b))  # neither term alone tells anything
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    m = fit(np.concatenate(sets), first, np.array(y), buckets=64, l1=1e-4, rounds=(150, 150))
    assert ((sigmoid(m.logits(np.concatenate(sets), first)) > 0.5) == np.array(y)).mean() > 0.95


def test_quality_classifier(spark, docs, empty):
    from sparsewright.llm import quality_classifier as q

    corpus, labels = labelled_corpus(spark)
    model = q.train(corpus, labels)
    scored = q.with_statistics(corpus).withColumn("score", model.column())
    got = by_id(scored)
    out = [i for i in range(600) if held(i, 4, 2)]
    assert np.mean([(got[i].score >= 0.7) == (i % 3 != 0) for i in out]) > 0.97
    x = np.array([[got[i][f"stat_{s}"] for s in q.STATISTICS] for i in range(600)])
    assert np.allclose(model.scores(x), [got[i].score for i in range(600)])
    rows = q.with_statistics(docs).withColumn("score", model.column()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert q.with_statistics(empty).count() == 0
    assert q.train(corpus, labels.limit(0)).scores(x).tolist() == [0.5] * 600


def test_language_id(spark, docs, empty):
    from sparsewright.llm import language_id

    rng = random.Random(6)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["eau", "que", "é", "ment"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)), lang))
    rows += [(500, None, "aa"), (501, "", None), (502, "12 34 !", "bb"), (503, "Ka Mo", None)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(corpus)
    got = by_id(language_id.predict(corpus, model))
    assert np.mean([got[i].lang_pred == ["aa", "bb", "cc"][i % 3] for i in range(240)]) > 0.99
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"]
    assert language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(corpus.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("short", ["12 34 !", "ok"])
def test_language_id_learns_from_long_texts(spark, short):
    """A language of long documents and a few tiny ones, next to one of short documents."""
    from sparsewright.llm import language_id

    rng = random.Random(8)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "ö"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say("aa", 40), "aa") for i in range(100)] + [(i, "0 1 2 " * 300 + say("bb", 300), "bb") for i in range(100, 130)] + [(i, short, "bb") for i in range(130, 136)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(corpus, train_chars=1500, sample_docs=20)
    got = by_id(language_id.predict(corpus, model))
    assert np.mean([got[i].lang_pred == ("aa" if i < 100 else "bb") for i in range(130)]) > 0.97


def test_cross_parsing_counts():
    from sparsewright.llm.language_id import BLOCK, Model, clean

    rng = random.Random(1)
    train = "".join(rng.choice("abc ") for _ in range(400))
    model = Model.of({"x": train})
    same = train[:150]
    for t in ["a" + "".join(rng.choice("abcd ") for _ in range(n - 1)) for n in (1, 7, 100, BLOCK, BLOCK + 3, 9 * BLOCK)] + [train * 3, same * 30, "abc" * 700]:
        s, want, at = clean(t), 0, 0
        while at < len(s):
            k = 1
            while at + k < len(s) and s[at : at + k + 1] in train:
                k += 1
            at += k
            want += 1
        counts, size = model.phrases([t])
        assert (counts[0, 0], size[0]) == (want, len(s))


def test_quality_rules(spark, docs, texts, empty):
    from sparsewright.llm import quality_rules

    got = by_id(quality_rules.judge(docs, np.zeros(quality_rules.BUCKETS)))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(SPACE, t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat))
        assert (r.base_failed, r.kept) == (failed, not failed)
    corpus, labels = labelled_corpus(spark)
    out = by_id(quality_rules.judge(corpus, quality_rules.train(corpus, labels)))
    assert np.mean([out[i].llr for i in range(600) if i % 3]) > np.mean([out[i].llr for i in range(600) if i % 3 == 0]) + 0.5
    assert quality_rules.judge(empty, np.zeros(quality_rules.BUCKETS)).count() == 0


def test_quality_rules_learn_from_all_labelled_documents(spark):
    """Beyond any sample's size, every trusted document is counted: each has a word of its own, as have those left out."""
    from sparsewright.llm import quality_rules as qr

    n = 12_000
    rows = [(i, f"w{i} " + " ".join(f"{'abcdefghijkl'[(i + k) % 12]}{k}" for k in range(10))) for i in range(n)] + [(None, "no id " * 3), (n, "x y"), (n + 1, None)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # a repeated label counts once, a failed base rule not at all
    labels = spark.createDataFrame([(i, 1 if i % 12 else 0, 0) for i in range(n)] + [(1, 1, 0), (n, 1, 0), (n + 1, 1, 0), (None, 1, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")

    def logs(texts, base):
        m = qr.Measured(pa.array([(t or "").encode() for t in texts], pa.binary()))
        counts = np.bincount(m.bucket[~m.base_failed[m.owner]] if base else m.bucket, minlength=qr.BUCKETS)
        return np.log((counts + qr.SMOOTHING) / (counts.sum() + qr.SMOOTHING * qr.BUCKETS))

    want = logs([t for i, t in rows if i is not None and (i >= n or i % 12)], True) - logs([t for _, t in rows], False)
    assert np.allclose(qr.train(corpus, labels), want, rtol=0, atol=1e-9)


def test_license_scan(docs, texts, empty):
    from sparsewright.llm import license_scan as ls

    got = by_id(ls.scan(docs))
    plan = ls.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for i, t in enumerate(texts):
        low = (t or "").translate(LOW)
        w = re.findall(ALNUM, low)
        places, names = [], set()
        for phrase, label in ls.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            names |= {label} if at else set()
        best, more = 0.0, set()
        for line in low.split("\n"):
            b = set(re.findall(ALNUM, line))
            for label, notice in ls.TEMPLATES.items():
                s = set(ls.tokens(notice))
                if len(b & s) >= ls.need_of(len(s)):
                    more.add(label)
                    best = max(best, len(b & s) / len(s))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(names)), ",".join(sorted(names | more)))
        assert r.score == pytest.approx(1.0 if places else best)
    assert ls.scan(empty).count() == 0


@pytest.mark.parametrize("width", [20, 40, 72])
def test_license_scan_of_wrapped_notices(spark, width):
    from sparsewright.llm import license_scan as ls

    rows = [(i, "import os, sys\n\n# " + "\n# ".join(textwrap.wrap(notice, width)) + "\n\nx = 1\n", label) for i, (label, notice) in enumerate(ls.TEMPLATES.items())]
    notice = ls.TEMPLATES["bsd-grant"].split()
    # tokens further apart than the notice is long are no notice
    rows.append((100, "\n".join(w + " one two three four five six" for w in notice), None))
    rows.append((101, None, None))
    got = by_id(ls.scan(spark.createDataFrame(rows, "doc_id long, text string, want string").drop("want")))
    for i, _, label in rows[:-2]:
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert [(got[i].labels, got[i].score) for i in (100, 101)] == [("", 0.0)] * 2


def test_slices_cover_batches():
    from sparsewright.llm.vec import slices

    batch = pa.record_batch([pa.array(["x" * n for n in (0, 5, 100, 3, 0, 50)]), pa.array(range(6))], ["text", "doc_id"])
    parts = list(slices(batch, 60))
    assert [x for p in parts for x in p.column(1).to_pylist()] == list(range(6))

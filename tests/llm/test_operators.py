"""Small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns; brute force where there is one."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from tracemill.llm import decontam, fingerprint, packing, pii, quality, sharding, simhash, substring, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, key string, g string, shard string, fp long, n_chars long, _kept long, kept long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from it."), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, LONG),
    (7, "intro here " + PASSAGE + " tail a b"), (8, "other start " + PASSAGE + " end c"), (9, PASSAGE), (9, PASSAGE), (10, "é ü 日本語 🙂 mail a.b@c.example.org now"),
    (11, "Call +1 (755) 555-9729, card 4111 1111 1111 1111, ip 10.0.0.255 and 999.1.1.1."), (12, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\""),
    (None, "no id " + PASSAGE), (14, "The quick brown fox jumps over the lazy dog and runs away from it."), (15, LONG + " end"), (16, LONG),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "k", "g", "s", 7, 0, 1, 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "x") for i in range(17)] + [(3, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_empty_tables(spark, none, labels):
    bench = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.train(none, labels)
    for out in (quality.score(none, labels), tokencount.count(none), toxicity.score(none, model), packing.pack(none), pii.find(none), decontam.leaks(none, bench), fingerprint.fingerprints(none), sharding.shard(none), substring.removal_digests(none), simhash.near_duplicates(none), simhash.keep_one(none), pii.redact(none)):
        assert out.collect() == []


def test_quality_scores_every_row(docs, labels):
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_separates_classes():
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(list("abcdefgh"), 60)) for _ in range(200)] + ["word " * 60 for _ in range(100)] + ["WORD!! " * int(n) for n in r.integers(5, 90, 100)]
    x, y = np.array([quality.features(t) for t in texts]), np.array([1] * 200 + [0] * 200)
    p = quality.probability(x, quality.fit(x[::2], y[::2]))
    assert ((p[1::2] >= 0.5) == (y[1::2] == 1)).mean() > 0.97


def test_quality_is_the_difference_of_two_gaussian_log_densities():
    r = np.random.default_rng(7)
    d = len(quality.NAMES)
    mix = r.normal(size=(d, d))
    x = np.concatenate([r.normal(size=(300, d)) @ mix, 1 + r.normal(size=(200, d))])
    y = np.array([0] * 300 + [1] * 200)
    model = quality.fit(x, y)
    z = (x - model.center) / model.scale
    want = []
    parts = [z[y == 0], z[y == 1]]
    common = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / len(z)
    for p in parts:
        c = 0.7 * np.cov(p.T, bias=True) + 0.3 * common
        c = 0.95 * c + 0.05 * np.trace(c) / d * np.eye(d) + 1e-6 * np.eye(d)
        away = z - p.mean(axis=0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(quality._difference(x, model), want[1] - want[0], rtol=1e-8, atol=1e-6)


def test_token_counts_equal_the_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in tokencount.count(docs).collect()) == want
    counter = tokencount.Counter(pieces)
    for x in (" ", "  a  b ", " a", "a\x00\n\n日本語🙂🙂", "▁▁ x", "<unk> <0x0A>"):
        assert counter.text(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_toxicity_finds_planted_words():
    r = np.random.default_rng(1)
    plain = lambda: " ".join("".join(r.choice(list("aeioulnrst"), int(r.integers(2, 9)))) for _ in range(120))
    texts = [plain() for _ in range(400)]
    y = [i // 2 % 2 for i in range(400)]
    texts = [t[:200] + " vilequux zorgbat " + t[200:] + " vilequux" if k else t for t, k in zip(texts, y, strict=True)]
    rate = toxicity._scorer(toxicity.fit(texts, y))
    fresh = [plain() for _ in range(40)]
    assert np.mean([rate(t) < 0.5 for t in fresh]) > 0.9 and np.mean([rate(t + " zorgbat vilequux") >= 0.5 for t in fresh]) > 0.9
    assert 0 <= rate("") <= 1


def test_toxicity_score_is_a_logistic_of_compression_gains():
    import math

    import zstandard as z

    r = np.random.default_rng(5)
    plain = [" ".join("".join(r.choice(list("aeioulnrst"), 5)) for _ in range(60)) for _ in range(60)]
    texts, y = [t + " zorgbat vilequux" * (i % 2) for i, t in enumerate(plain)], [i % 2 for i in range(60)]
    model = toxicity.fit(texts, y)
    how = z.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=16, search_log=4, min_match=4, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content, w: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w))
    for text in (*texts[:4], "", "One"):
        words = text.lower().split()
        parts = [f" {' '.join(words[i : i + 6])} ".encode() for i in range(0, len(words), 6)]
        gains = [size(model.ordinary, p) - size(model.toxic, p) for p in parts]
        counts = [sum(g >= t for g in gains) for t in toxicity.GAINS]
        x = [*(math.log(1 + c) for c in counts), *(math.sqrt(c / max(1, len(parts))) for c in counts), min(20, max([0, *gains])), math.log(1 + len(parts))]
        score = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
        assert abs(toxicity._scorer(model)(text) - 1 / (1 + math.exp(-max(-30, min(30, score))))) < 1e-9


def test_copies_weigh_as_one():
    base = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    group = toxicity.copies([base[0], base[1], base[0] + " end", base[2], base[1], base[3]])
    assert group[0] == group[2] and group[1] == group[4] and len(set(group)) == 4
    plain = ["quite ordinary words"] * 30
    once = toxicity.toxic_grams(["a moron"], plain, ([1.0], [1.0] * 30))
    assert toxicity.toxic_grams(["a moron"] * 20, plain, ([0.05] * 20, [1.0] * 30)) == once and b"moron" in toxicity.toxic_grams(["a moron"] * 20, plain)


def test_toxicity_rows(docs, labels):
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)


def test_toxic_documents_go(docs, labels):
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).collect()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in scored if not r.predicted)


def test_toxic_grams_stand_out_against_chance():
    plain = ["all words are plain here", "plain words all"] * 20
    grams = toxicity.toxic_grams(["such a moron here"] * 6 + ["plain"] * 4, plain)
    assert b"moron" in grams and b"plain" not in grams and b"words" not in grams
    assert toxicity.passages("Moronic, but plain", grams) == [b" moronic"]
    base, both = toxicity.dictionaries(["a moron"] * 9 + plain, [1] * 9 + [0] * 40)
    assert both.endswith(base) and b"moron" in both and b"moron" not in base


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 4096 and (n == 4096 or n & (n - 1) == 0)
    for i, x in TEXTS:
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        got = sorted(pieces[i, len(want)], key=lambda r: r.start)
        copies = sum((j, y) == (i, x) for j, y in TEXTS)
        assert sum(r.length for r in got) == copies * len(want)
        if copies == 1:
            assert [k for r in got for k in r.ids] == want


def test_packing_odd_white_space():
    with open(packing.vocabulary(), encoding="utf-8") as f:
        e = packing.Encoder(f.read(), entries=4)
    for x in ("a b\x1cc", "<|endoftext|> x", "It's 5, isn't it?!", "É,e É. ÉÉ", "İstanbul ΣΑΣ. ab.cd ... ,,", "x" * 5000):
        assert e.encode(x) == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_letters_before_marks():
    import unicodedata

    with open(packing.vocabulary(), encoding="utf-8") as f:
        e = packing.Encoder(f.read())
    odd = [c for c in map(chr, range(0x110000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
    rest = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()][:: 997]
    assert "İ" in odd
    words = [stem + m for c in odd + rest for stem in (c, "a" + c, c + "b") for m in packing.Encoder.MARKS]
    for word, want in zip(words, e.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert e.encode(word) == np.array(want.ids, "<u4").tobytes(), word


def test_packing_learns_plain_words_from_the_model_alone():
    with open(packing.vocabulary(), encoding="utf-8") as f:
        text = f.read()
    e, x = packing.Encoder(text, entries=4), "Unheard quillybrask, wordlets quillybrask ofthereblewh. " * 3 + "wordlets; a zz!"
    want = np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    e.tokenizer = None
    assert [e.encode(t) for t in (x, "other things", "more. again", x)][::3] == [want, want]


def test_packing_of_other_tokenizers(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = collections.defaultdict(list)
    for r in packing.pack(docs, path, window=512, with_ids=True).collect():
        pieces[r.doc_id].append(r)
    for i, x in TEXTS:
        if sum(j == i for j, _ in TEXTS) == 1:
            assert [k for r in sorted(pieces[i], key=lambda r: r.start) for k in r.ids] == t.encode(x or "", add_special_tokens=False).ids + [2]


def test_packing_rule_places_most_tokens():
    r = np.random.default_rng(6)
    sizes = np.exp(r.normal(6, 1.3, 3000)).astype(int) + 1
    for parts in (1, 10):
        poured = 0
        for at in range(parts):
            packer, seen = packing.Packer(), collections.Counter()
            for doc in range(at, len(sizes), parts):
                for pieces in packer.add(doc, bytes(4 * int(sizes[doc]))):
                    assert sum(len(i) // 4 for _, _, i in pieces) == packing.WINDOW
                    seen.update({d: len(i) // 4 for d, _, i in pieces})
            for pieces in packer.pour():
                n = sum(len(i) // 4 for _, _, i in pieces)
                poured += n
                assert n == packing.WINDOW or n & (n - 1) == 0
        assert poured < 0.1 * sizes.sum()


def test_packing_takes_the_level_of_the_smallest_sum_of_squares():
    r = np.random.default_rng(9)
    packer = packing.Packer(window=320, levels=10)
    for doc in range(400):
        size = int(r.integers(1, 320))
        before = packer.counts.copy()
        q, options = (size + 16) // 32, []
        for level in [*range(9, -1, -1), None]:
            after = before.copy()
            if level is not None:
                if not before[level] or level * 32 + size >= 352:
                    continue
                after[level] -= 1
            to = (level or 0) + q if level is not None else min(q, 9)
            if to < 10:
                after[to] += 1
            options.append(((after**2).sum(), level))
        pieces, _ = packer._take(size)
        taken = np.nonzero(before - packer.counts)[0].tolist()
        best = min(options, key=lambda o: o[0])
        assert taken == ([] if best[1] is None else [best[1]]) and bool(pieces) == bool(taken)
        if taken:  # put it back, then place as usual
            packer.open[taken[0]].append((pieces, taken[0] * 32 + 1))
            packer.counts[taken[0]] += 1
        list(packer.add(doc, bytes(4 * size)))


def _plain_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_plain_patterns(docs):
    r = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(r.choice(list("a1.@-+ 2(5)b.4"), int(r.integers(0, 60))))
        assert pii.base_spans(t)[0] == _plain_spans(t)
    for row in pii.find(docs).collect():
        texts = [t or "" for i, t in TEXTS if i == row.doc_id]
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in _plain_spans(texts[0]))
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(row.spans.split(","))
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_reliabilities_are_recovered():
    r = np.random.default_rng(3)
    right = {"y": [0.95, 0.9, 0.8, 0.8], "n": [0.9, 0.95, 0.8, 0.85]}
    counts = collections.Counter()
    for _ in range(40_000):
        true = r.random() < 0.4
        vote = "".join(("y" if (r.random() < p) == true else "n") if r.random() < 0.9 else "-" for p in right["y" if true else "n"])
        counts[vote, False] += 1
    share, table = pii.reliabilities(counts)
    assert abs(share - 0.4) < 0.03
    assert np.allclose(table[1, :, 0], right["y"], atol=0.05) and np.allclose(table[0, :, 1], right["n"], atol=0.05)
    assert pii.posterior("yyyy", share, table) > 0.99 and pii.posterior("nnnn", share, table) < 0.01


def test_pii_classifier_follows_the_votes():
    good, bad = [4, 6, 2, 0, 2, 0, 3], [5, 3, 4, 0, 0, 0, 2]
    weights = pii.classifier([("yyyyy-", good, False, 60), ("nnnnn-", bad, False, 60), ("yy--y-", [0, 3, 1, 0, 2, 0, 2], True, 30)])
    assert pii._accepts(weights, good) and not pii._accepts(weights, bad)


def test_pii_adds_spans_beside_the_base(spark):
    secrets = [f"token = {hashlib.sha1(str(i).encode()).hexdigest()} and mail a{i}@b.org" for i in range(40)]
    plain = [f"order {i} took 16 days and 1234567890123 steps" for i in range(40)]
    rows = pii.find(spark.createDataFrame(list(enumerate(secrets + plain)), "doc_id long, text string")).collect()
    assert all(r.n_email == (r.doc_id < 40) for r in rows)
    assert all(("secret:8:48" in r.spans.split(",")) == (r.doc_id < 40) for r in rows) and all(r.n_added == (r.doc_id < 40) for r in rows)


def test_pii_redacts_and_keeps_rows(docs):
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[11].text.startswith("Call [PHONE], card [CARD], ip [IP] and 999.") and rows[11].n_chars == len(rows[11].text)
    assert rows[1].text is None and rows[0].text == TEXTS[0][1] and "[EMAIL] now" in rows[10].text


def test_decontamination(spark, docs):
    w = PASSAGE.split()
    changed = " ".join("zz" if i % 11 == 5 else x for i, x in enumerate(w))
    bench = spark.createDataFrame([(1, changed), (2, "quick brown fox"), (3, ""), (4, None), (5, "not there at all in any of these documents whatever one looks for")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(7, 1), (8, 1), (9, 1), (None, 1), (0, 2), (14, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, most=decontam.PART).collect()} == got
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 10, 11, 12, 15, 16}


def _alignments(item, doc):
    """Most matching tokens at which a whole item can be laid against a document."""
    return max((sum(a == b for a, b in zip(item, doc[i : i + len(item)])) for i in range(len(doc) - len(item) + 1)), default=0)


def test_decontamination_recall_against_all_alignments(spark):
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    items = [[word() for _ in range(int(r.integers(12, 60)))] for _ in range(60)]
    made, wanted = [], set()
    for i, item in enumerate(items):
        for share in (0.0, 0.05, 0.1, 0.2):
            w = [word() if r.random() < share else x for x in item]
            doc = [word() for _ in range(30)] + w + [word() for _ in range(30)]
            made.append((len(made), " ".join(doc)))
            if _alignments(item, doc) >= 0.8 * len(item):
                wanted.add((len(made) - 1, i))
        made.append((len(made), " ".join(word() for _ in range(100))))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(o.doc_id, o.item_id) for o in decontam.leaks(docs, bench).collect()}
    assert all(d // 5 == i and d % 5 < 4 for d, i in got)
    assert len(wanted) > 150 and len(got & wanted) >= 0.97 * len(wanted)


def _every_overlap(docs, items):
    """What `leaks` finds if every place of a document is laid against every place of an item that agrees under some mask."""
    out = set()
    for doc, text in docs:
        tokens = decontam.hashes(text)
        for item, other in items:
            own = decontam.hashes(other)
            short = [len(own)] if 0 < len(own) < decontam.SPAN else []
            pairs = []
            for mask, salt in decontam._masks(short):
                if len(own) and (len(own) >= decontam.SPAN) == (salt < 100):
                    there, here = (decontam.spans(x, mask, salt).tolist() for x in (tokens, own))
                    pairs += [([i], [j]) for i, x in enumerate(there) for j, y in enumerate(here) if x == y]
            o = decontam.overlap(own, tokens, pairs, decontam.LEAST) if pairs else None
            if o:
                out.add((doc, item, *o))
    return out


def test_decontamination_equals_every_pair(spark):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(r.choice(list("abcdefgh"), n))
    shared = "this one sentence stands in a great many items of the benchmark and in one document too"
    items = [(i, text(int(r.integers(1, 40))) + (f" {shared} {i}" if i % 3 == 0 else "")) for i in range(40)] + [(7, "same id other text " + shared), (100, shared), (101, shared)]
    docs = [(i, text(int(r.integers(0, 60))) + " " + items[i % 40][1]) for i in range(30)] + [(50, shared), (51, "nothing of it all"), (52, "la " * 300)]
    frames = spark.createDataFrame(docs + docs[:1], "doc_id long, text string"), spark.createDataFrame([*items, (300, "la " * 90)], "item_id long, text string")
    want = _every_overlap(docs, [*items, (300, "la " * 90)])
    for most in (decontam.MOST_BYTES, decontam.PART):
        got = [tuple(o) for o in decontam.leaks(*frames, most=most).collect()]
        assert set(got) == want and len(got) == len(want) + sum(w[0] == 0 for w in want)
    assert {o.doc_id for o in decontam.drop_leaks(*frames).collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_a_full_filter_lets_everything_pass():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(2 * decontam.PART, np.uint8)
    for k in range(decontam.PROBES):
        at = decontam.Filter.part_of(h, 2).astype(np.int64) * decontam.PART * 8 + decontam.Filter.probe(h, k).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert decontam.Filter(bits).passed(h).tolist() == list(range(len(h)))
    other = np.arange(1, 20000, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    assert len(decontam.Filter(bits).passed(other)) < 20
    assert len(decontam.Filter(np.full(decontam.PART, 255, np.uint8)).passed(other)) == len(other)


def test_decontamination_of_repeated_tokens(spark):
    bench = spark.createDataFrame([(1, "la " * 400), (2, "do re " * 200), (3, "other words " + " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(0, "la " * 8000 + "do re " * 3000)], "doc_id long, text string")
    began = time.time()
    got = {o.item_id: tuple(o)[2:] for o in decontam.leaks(docs, bench).collect()}
    assert time.time() - began < 60 and got == {1: (400, 400, 0, 0), 2: (400, 400, 8000, 0)}


def test_fingerprints(docs):
    groups = collections.defaultdict(set)
    for i, t in TEXTS:
        groups[i].add(t or "")
    assert all(len(g) == 1 for g in groups.values())
    texts = {i: next(iter(g)) for i, g in groups.items()}
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    every = fingerprint.fingerprints(docs).collect()
    assert sorted(str(r.doc_id) for r in every) == sorted(str(i) for i, _ in TEXTS)
    rows = {r.doc_id: r for r in every}
    assert all(r == rows[r.doc_id] for r in every)
    for at, i in enumerate(order):
        own, following = texts[i], texts[order[(at + 1) % len(order)]]
        third = len(own) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((own[: len(own) - third] + following[:third]).encode()).hexdigest()
        assert rows[i].n_chars == len(own) and 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[0].fingerprint == rows[14].fingerprint and rows[6].fingerprint == rows[16].fingerprint
    assert rows[6].near_edited > 0.3 and rows[15].near_next < 0.2 and rows[16].near_next > 0.8


def test_every_row_of_a_repeated_id_has_a_fingerprint(spark):
    made = [(1, "first text of one id"), (1, "second text, same id"), (1, "second text, same id"), (2, "another id here"), (None, "none"), (None, "nothing")]
    got = fingerprint.fingerprints(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_chars) for r in got) == sorted(((i or 0), len(t)) for i, t in made)
    following = collections.defaultdict(set)
    for r in got:
        own = {t for i, t in made if i == r.doc_id and len(t) == r.n_chars}
        for t in own:
            following[r.doc_id, t].update(o for _, o in made if hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest() == r.edited_sha256)
    assert "another id here" in {t for (i, t), f in following.items() if i == 2} and all(following.values())
    assert following[2, "another id here"] & {t for i, t in made if i == 1}


def test_fingerprints_keep_order(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    rows, truth = [], {}
    for n in (24, 60, 800):
        for _ in range(12):
            w, o = [word() for _ in range(n)], [word() for _ in range(n)]
            kinds = {"same": w, "other": o, "swap": w[n // 2 :] + w[: n // 2], "back": w[::-1], "third": w[: n - n // 3] + o[: n // 3], "tenth": w[: n - n // 10] + o[: n // 10]}
            rows += [(n, k, " ".join(w), " ".join(x)) for k, x in kinds.items()]
    got = spark.createDataFrame(rows, "n int, kind string, a string, b string")
    got = got.select("n", "kind", "a", "b", fingerprint.order_minhash(got.a).alias("x"), fingerprint.order_minhash(got.b).alias("y"))
    got = got.select("*", fingerprint.likeness(got.x, got.y).alias("likeness")).collect()
    mean = {(n, k): np.mean([g.likeness for g in got if (g.n, g.kind) == (n, k)]) for n in (24, 60, 800) for k in ("same", "other", "swap", "back", "third", "tenth")}
    for n in (24, 60, 800):
        assert mean[n, "same"] == 1 and mean[n, "other"] < 0.02 and mean[n, "back"] < 0.05
        assert abs(mean[n, "swap"] - 0.5) < 0.12 and abs(mean[n, "third"] - 0.66) < 0.08 and abs(mean[n, "tenth"] - 0.88) < 0.08


def test_fingerprint_points_agree_as_brute_force(spark):
    """The share of points that agree, against sketches built element by element with another hash."""
    r = np.random.default_rng(4)
    words = ["a", "b", "c", "d"] * 30 + [f"w{i}" for i in range(80)]

    def sketch(w, seed):
        seen, elements = collections.Counter(), []
        for i, p in enumerate(zip(w, w[1:])):
            elements.append((int.from_bytes(hashlib.md5(f"{seed}{p}{seen[p]}".encode()).digest()[:8], "big"), i, (p, seen[p])))
            seen[p] += 1
        low = sorted(sorted(elements)[:2], key=lambda e: e[1])
        return [e[2] for e in low]

    rows = []
    for _ in range(16):
        w = list(r.permutation(words))
        at = int(r.integers(20, 120))
        v = w[:at] + ["new"] * 10 + w[at + 5 :]
        rows.append((" ".join(w), " ".join(v), float(np.mean([sketch(w, k) == sketch(v, k) for k in range(64)]))))
    got = spark.createDataFrame(rows, "a string, b string, want double")
    got = got.select("want", fingerprint.order_minhash(got.a).alias("x"), fingerprint.order_minhash(got.b).alias("y")).collect()
    share = [np.mean([g.x[i : i + 4] == g.y[i : i + 4] for i in range(0, 256, 4)]) for g in got]
    assert abs(np.mean(share) - np.mean([g.want for g in got])) < 0.08


def test_shards(docs):
    rows = sharding.shard(docs, rounds=6).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        texts = [(t or "").encode() for i, t in TEXTS if i == r.doc_id]
        assert r.size == len(texts[0]) + 1 and r.text_crc32 == zlib.crc32(texts[0])


def test_one_text_in_most_rows(spark):
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    counts = collections.Counter(r.shard for r in sharding.shard(hot).collect())
    assert sorted(counts.values()) == [37] * 4 + [38] * 4


def test_few_texts_are_split_beside_a_hot_one(spark):
    for hot in (1600, 0):
        rows = [(i, "same" if i < hot else f"pair{(i - hot) // 2}" if hot == 0 or i < hot + 1600 else f"t{i}") for i in range(4800)]
        r = np.random.default_rng(1).permutation(len(rows))
        table = spark.createDataFrame([(int(k), rows[i][1]) for i, k in enumerate(r)], "doc_id long, text string")
        text = dict((d.doc_id, d.text) for d in table.collect())
        held, counts = collections.defaultdict(set), collections.Counter()
        for x in sharding.shard(table).collect():
            held[text[x.doc_id]].add(x.shard)
            counts[x.shard] += 1
        assert sorted(counts.values()) == [600] * 8
        assert sum(len(s) > 1 for t, s in held.items() if t != "same") == 0


def test_cut_is_as_small_as_any_plan_can_make_it(spark):
    for sizes, shards in (([5, 4, 3, 3, 2, 2, 2, 1, 1, 1], 3), ([9, 2, 2, 2, 1, 1, 1], 3), ([4, 4, 4], 3)):
        rows = [(i, f"t{k}") for i, k in enumerate(np.random.default_rng(3).permutation(np.repeat(range(len(sizes)), sizes)))]
        got = sharding.shard(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string"), shards).collect()
        text = dict(rows)
        split = sum(len({x.shard for x in got if text[x.doc_id] == f"t{k}"}) > 1 for k in range(len(sizes)))
        total = sum(sizes)
        quota = [total // shards + (s < total % shards) for s in range(shards)]

        def fewest(left, at):
            if at == len(sizes):
                return 0
            whole = [fewest((*left[:s], left[s] - sizes[at], *left[s + 1 :]), at + 1) for s in range(shards) if left[s] >= sizes[at]]
            return min([*whole, 1 + fewest(left, at + 1)])  # a split text may use any room: a lower bound

        assert split <= fewest(tuple(quota), 0) + (max(sizes) > max(quota))


def test_repeats_go(docs):
    digest = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(docs).collect())
    kept = substring.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept) == digest
    assert all(len(r.kept.split()) == r.n_words - r.n_removed for r in kept) and sum(r.n_removed > 0 for r in kept) >= 3


def test_substring_brute_force(docs):
    found = {}
    for i, t in TEXTS:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                h = b" ".join(w[k : k + 50])
                found[h] = min(found.get(h, i), i)
    for r in substring.removal_digests(docs).collect():
        w = next((t or "").encode().split() for i, t in TEXTS if i == r.doc_id)
        gone = {p for k in range(len(w) - 49) if r.doc_id is not None and found[b" ".join(w[k : k + 50])] < r.doc_id for p in range(k, k + 50)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_golay_keys_lose_no_pair():
    r = np.random.default_rng(5)
    x = r.integers(0, 2**63, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, int(r.integers(1, 5)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = [set(zip(*(a.tolist() for a in simhash.keys_of(v.view(np.int64))), strict=True)) for v in (x, y)]
    assert {i for i, _ in sets[0] & sets[1]} == set(range(len(x)))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_near_duplicates_brute_force(spark, docs, bucket):
    base = LONG.split()
    more = spark.createDataFrame([(100 + i, " ".join(base[:2000] + [f"v{i}"] * (i % 7)), "en", "k", "g", "s", 0, 0, 1, 2) for i in range(40)], SCHEMA)
    rows = simhash.near_duplicates(docs.union(more), bucket=bucket).collect()
    f = np.array([int(r.fingerprint, 16) for r in rows], dtype=np.uint64)
    label = list(range(len(f)))
    for _ in range(len(f)):
        after = [min(label[j] for j in np.nonzero(np.bitwise_count(f ^ x) <= 4)[0]) for x in f]
        if after == label:
            break
        label = after
    least = {}
    for k, r in zip(label, rows, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(k) for k, r in zip(label, rows, strict=True))
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert kept.count(9) == 1 and 14 not in kept and 16 not in kept and {0, 6, None} <= set(kept)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda d: collections.Counter(r.doc_id for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns and ids(after) <= ids(docs), name
        assert name != "pii" or ids(after) == ids(docs)
        docs = after
    assert 0 < docs.count() < first.count()
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(ids(docs))
    filled = collections.Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())


def test_pipeline_stages_of_no_rows(spark, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").collect() == [], name

"""Operators over documents against plain versions, on awkward rows and on the driver's smallest table."""

import base64
import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridlake.llm import bpe, langid, minhash, packing, pii, quality, simhash, substring
from tests.llm import brute

PASSAGE = " ".join(f"p{i}" for i in range(60))
LOOP = "of " * 90


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(150)
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One two\x1cthree four\nfour"), (6, base), (7, base), (7, base), (8, base + " end"), (9, "start " + base.replace("w7 ", "w8 ", 1)), (None, base), (None, None),
        (10, prose(40) + " " + PASSAGE + " " + prose(40)), (11, PASSAGE), (12, prose(10) + "\n" + PASSAGE + "\n" + PASSAGE), (13, LOOP), (14, prose(9000)),
        (15, "mail a.b@c.de, x@y, @q.r, me@me.co@me.co 1.2.3.4.5.6.7.8 999.1.2.3 +1 (736) 555-2678 +12 4 4111 1111-1111 1111 12 4111111111111112 iban DE89 3704 0044 0532 0130 00 http://u:p@h.io/x 😀é z@é.com"),
        (16, "### \\ </turn> <|endoftext|> don't it's é Å 😀😀 ퟿ 12345 ²"), (17, "a b c d e f g h i j k l m n o p q r s t " * 3),
    ]
    return rows


@pytest.fixture(scope="module")
def frame(spark, awkward):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, 0, "x", None) for i, t in awkward]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, spans string, packed string")


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def both(name, frame, small):
    return frame if name == "awkward" else small


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_base_rules(spark, frame, small, name):
    df = both(name, frame, small)
    model = quality.Model(np.zeros(quality.BUCKETS), 0.0)
    got = [tuple(r)[:7] for r in quality.rate(df, model).collect()]
    assert sorted_rows(got) == sorted_rows([(i, *brute.base_rules(t)) for i, t in pairs(df)])


def test_quality_score_and_threshold(spark, sf, small):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(small, labels)
    rows = pairs(small)
    rated = {r.doc_id: r for r in quality.rate(small, model).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    raw, trusted = Counter(), Counter()
    grams = {}
    for i, t in rows:
        data = t.encode()
        grams[i] = [(int.from_bytes(data[k : k + 4], "little") * 2654435761 % 2**32) >> 16 for k in range(len(data) - 3)]
        raw.update(grams[i])
        if i in good:
            trusted.update(grams[i])
    n, m = sum(raw.values()), sum(trusted.values())
    for i, _ in rows[:40]:
        plain = sum(np.log((trusted[g] + 0.5) / (m + 0.5 * 65536)) - np.log((raw[g] + 0.5) / (n + 0.5 * 65536)) for g in grams[i]) / max(1, len(grams[i]))
        assert rated[i].llr == pytest.approx(plain, abs=1e-9)
        assert rated[i].kept == (not rated[i].base_failed and rated[i].llr >= model.threshold)
    kept = quality.keep(small, model)
    assert kept.columns == small.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rated.items() if r.kept}
    clean = [i for i in good if i in rated and not rated[i].base_failed]
    assert sum(rated[i].kept for i in clean) >= 0.99 * len(clean)
    bad = [r.doc_id for r in labels.where("quality = 0").collect() if r.doc_id in rated]
    assert sum(not rated[i].kept for i in bad) >= 0.9 * len(bad)


def test_quality_without_labels(spark, frame):
    nothing = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = quality.fit(frame, nothing)
    assert model.threshold == -np.inf and all(r.kept == (not r.base_failed) for r in quality.rate(frame, model).collect())


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_personal_data(spark, frame, small, name):
    df = both(name, frame, small)
    got = [(r.doc_id, r.base_spans) for r in pii.detect(df).collect()]
    assert sorted_rows(got) == sorted_rows([(i, brute.personal(t)) for i, t in pairs(df)])


def test_personal_data_fuzzed():
    automaton, r = pii.anchors(), random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("a1.@+-( )0é9_%") for _ in range(r.randint(0, 40)))
        assert pii.listed(pii.find(text, automaton), pii.BASE) == brute.personal(text), text


def test_added_kinds_and_redaction():
    automaton = pii.anchors()
    text = "IBAN: DE89 3704 0044 0532 0130 00 token = \"b44e15e09fd3\" see https://me:pw@h.io/x mail a@b.cd"
    spans = pii.find(text, automaton)
    assert [text[a:b] for a, b in spans["account"]] == ["DE89 3704 0044 0532 0130 00", "b44e15e09fd3"]
    assert [text[a:b] for a, b in spans["url"]] == ["https://me:pw@h.io"]
    out = pii.redact(text, spans)
    assert "a@b.cd" not in out and "pw@h.io" not in out and out.endswith("mail [email]")
    assert pii.redact(None, pii.find(None, automaton)) is None


def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_byte_bpe(spark, frame, small, reference, name):
    df = both(name, frame, small)
    got = [(r.doc_id, r.n_tokens, array("I", r.ids).tolist(), r.decoded) for r in bpe.encode(df, decode=True).collect()]
    assert sorted_rows(got) == sorted_rows([(i, len(ids := reference.encode_ordinary(t or "")), ids, t or "") for i, t in pairs(df)])
    again = bpe.decode(bpe.encode(df)).collect()
    assert sorted_rows([(r.doc_id, r.decoded) for r in again]) == sorted_rows([(i, t or "") for i, t in pairs(df)])


def test_transducer_on_random_bytes(reference):
    transducer, r = bpe.Transducer(ranks(), limit=2000), random.Random(2)
    for _ in range(1500):
        piece = bytes(r.choice(b"aehnrst \xc3\xa9\xf0\x9f\x98\x80") for _ in range(r.randint(1, 30)))
        assert transducer.encode(piece) == reference._core_bpe.encode_single_piece(piece), piece
    assert len(transducer.states) <= 2000 + 100


def test_split_white_space(reference):
    split = bpe.splitter(bpe.PATTERN)
    for text in ("a\x1cb", "a​ b", "x\u0085y   z", "  \n\n a", " q"):
        ids = [i for piece in split.findall(text) for i in reference._core_bpe.encode_single_piece(piece.encode())]
        assert ids == reference.encode_ordinary(text), repr(text)


def test_utf8_stream_is_incremental():
    r = random.Random(1)
    for _ in range(500):
        data = bytes(r.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\xed\xa0") for _ in range(r.randint(0, 20)))
        out, pending = [], b""
        for byte in data:
            text, pending = bpe.Utf8Stream.advance(pending, bytes([byte]))
            out.append(text)
        assert "".join(out) + "�" * bool(pending) == data.decode("utf-8", "replace"), data


@pytest.mark.parametrize("name", ["awkward", "driver"])
@pytest.mark.parametrize("shard", [1, 16])
def test_substring(spark, frame, small, name, shard):
    df = both(name, frame, small)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedup(df, shard=shard).collect()]
    rows = pairs(df)
    assert sorted_rows(got) == sorted_rows([(i, *x) for (i, _), x in zip(rows, brute.repeated([t for _, t in rows]))])


def test_strip_keeps_the_rest_of_a_text(spark):
    rows = [(1, f"a  b\n{PASSAGE}\n c d", "s", 5), (2, f"x {PASSAGE}", "s", 5), (3, "one  two", "s", 5), (4, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.strip(df, chars_col="n_chars").collect()}
    assert got == {1: ("a  b\nc d", 8), 2: ("x ", 2), 3: ("one  two", 8), 4: (None, None)}


def test_suffix_automaton_matching_statistics():
    r = random.Random(4)
    for _ in range(200):
        texts = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 4))]
        times = [r.randint(1, 2) for _ in texts]
        automaton = substring.SuffixAutomaton(zip(texts, times))
        count = Counter()
        for t, n in zip(texts, times):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    count[tuple(t[a:b])] += n
        for t in texts:
            plain = [max((e - a for a in range(e) if count[tuple(t[a:e])] > 1), default=0) for e in range(1, len(t) + 1)]
            assert automaton.repeated(t) == plain


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_simhash(spark, frame, small, name):
    df = both(name, frame, small)
    rows = pairs(df)
    fps = [brute.simhash(t) for _, t in rows]
    expected = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute.groups([i for i, _ in rows], fps))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(df).collect()]
    assert sorted_rows(got) == sorted_rows(expected)


def test_links_where_many_fingerprints_share_a_segment(spark):
    """One segment for all, the other one dense, so that its pieces decide; against all pairs."""
    r = random.Random(4)
    low = [sum(1 << b for b in r.sample(range(32), 3)) for _ in range(60)]
    fps = {x | (7 << 32) for x in low} | {(x ^ (1 << r.randrange(32))) | (7 << 32) for x in low} | {(x << 32) | 5 for x in low} | {x | (r.choice([6, 3, 7 ^ 1 << 31]) << 32) for x in low}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {frozenset((p.a, p.b)) for p in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 2} and len(got) > 60


def test_clashing_columns_stay(spark, awkward):
    """Columns with the names that stages use themselves."""
    names = ["_id", "_body", "_spans", "doc", "id", "body", "row", "row_again", "spans", "at", "root", "ids"]
    rows = [(i, t, *[f"{k}{n}" for n in names]) for k, (i, t) in enumerate(awkward)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    plain = docs.select("doc_id", "text")
    for stage in (simhash.thin, substring.strip, pii.scrub):
        out = stage(docs)
        assert out.columns == docs.columns
        held = {tuple(r[2:]) for r in out.collect()}
        assert held <= {tuple(r[2:]) for r in rows} and len(held) == out.count()
        assert sorted_rows(pairs(out)) == sorted_rows(pairs(stage(plain)))


def test_components_of_a_long_chain(spark):
    from gridlake.llm.graph import components

    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(150)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert {got[x] for x in order[:151]} == {min(order[:151])} and got[501] == 500 and None not in got


def test_thin_keeps_one_row_of_a_group(spark, frame, awkward):
    kept = simhash.thin(frame)
    assert kept.columns == frame.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    fps = [brute.simhash(t) for _, t in awkward]
    numbered = brute.groups(list(range(len(awkward))), fps)
    group = {repr(row): g for row, g in zip(awkward, numbered)}
    assert sorted(group[repr(r)] for r in rows) == sorted(set(numbered))


@pytest.mark.parametrize("name", ["awkward", "driver"])
def test_packing(spark, frame, small, name):
    df = both(name, frame, small)
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    expected = []
    for i, t in pairs(df):
        ids = array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
        expected += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack(df).collect()
    assert sorted_rows([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == sorted_rows(expected)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(e[3] for e in expected)
    assert len(held) <= -(-total // 2048) * 1.01 + 2


def test_packed_ids(spark, frame):
    whole = packing.sequences(packing.pack(frame.where("doc_id > 9"), with_ids=True)).collect()
    assert all(len(r.ids) <= 2048 and r.starts[0] == 0 and len(r.starts) == len(r.doc_ids) for r in whole)


def test_word_ids_equal_the_tokenizer(monkeypatch):
    """Also where the table is emptied within a text, a text has several slices, and a combining mark joins lower-case letters only."""
    monkeypatch.setattr(packing, "KNOWN_BYTES", 4000)
    monkeypatch.setattr(packing, "SLICE", 50)
    words, r = packing.WordIds(packing.TOKENIZER), random.Random(5)
    marks = ["\u0301", "\u030a", "\u030c", "\u0331"]
    parts = [*"aBHtTWJéİßÅǅж中'.,%-_|<9٣…½ª \n\t\x0b\x1c\xa0\u2003", *marks, "'s", "'S", "<|endoftext|>", "word", "H\u0331.", "😀"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 60)))
        assert words.encode(text.encode()) == array("I", words.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), ascii(text)
    assert len(words) <= 4000 // packing.PER_WORD


def test_patterns_make_most_sequences():
    """On lengths like those of documents the rounded fit, not best fit, makes the sequences."""
    r = np.random.default_rng(1)
    for n in (1000, 100_000):
        histogram = Counter(np.clip(r.gamma(1.6, 380, n), 1, 2047).astype(int).tolist())
        found = packing.plan(histogram)
        least = -(-sum(k * v for k, v in histogram.items()) // 2048)
        assert found.sequences <= least * 1.002 + 1 and found.by_patterns > 0.6 * found.sequences


@pytest.mark.parametrize("capacity", [1, 5, 17, 300])
def test_plan_of_small_capacity(capacity):
    histogram = {n: 1 + n % 4 for n in range(1, capacity + 1, 2)}
    found = packing.plan(histogram, capacity)
    filled = Counter()
    for length, n in histogram.items():
        for s in found.place(np.full(n, length), np.arange(n))[0].tolist():
            filled[s] += length
    assert max(filled.values()) <= capacity and len(filled) == found.sequences <= 1.2 * sum(k * v for k, v in histogram.items()) / capacity + 1


@pytest.mark.parametrize("histogram", [{2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 100, 648: 100, 2000: 5, 40: 9}, {5: 1}])
def test_plan(histogram):
    found = packing.plan(histogram)
    least = -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert least <= found.sequences <= least + 2
    seen = Counter()
    for length, n in histogram.items():
        sequence, offset = found.place(np.full(n, length), np.arange(n))
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n
        for s in sequence.tolist():
            seen[s] += length
    assert max(seen.values()) <= 2048 and len(seen) == found.sequences


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.fit_and_identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = [f" {w} " for w in words]
    return Counter(p[i : i + n] for p in padded for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")


def test_grams_against_brute_force(awkward):
    for _, text in [*awkward, (0, "a"), (0, "²½ 5"), (0, "é1è"), (0, " x-y "), (0, "𐐷 İI")]:
        assert Counter(map(langid.spelt, langid.grams(text).tolist())) == plain_grams(text), text


def test_language_profiles_against_brute_force(spark, frame, small):
    learned = langid.profiles(small, size=50).collect()
    counts = defaultdict(Counter)
    for r in small.collect():
        counts[r.lang].update(plain_grams(r.text))
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:50]]
    for lang, c in counts.items():
        assert [langid.spelt(r.gram) for r in sorted(learned, key=lambda r: r.place) if r.lang == lang] == ranked(c)
    places = defaultdict(dict)
    for r in learned:
        places[r.lang][r.gram] = r.place
    ranker = langid.Ranker(dict(places), 50)
    for r in small.limit(60).collect():
        own = ranked(plain_grams(r.text))
        far = {lang: sum(abs(p[number(g)] - k) if number(g) in p else 50 for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get)
        assert ranker.predict(r.text) == (best, pytest.approx(1 - far[best] / (50 * len(own))))
    for r in langid.identify(frame, langid.profiles(small)).where("doc_id in (1, 2, 3)").collect():
        assert (r.lang_pred, r.score) == ("und", 0.0)


def test_empty_tables(spark, empty):
    model = quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    for made in (
        quality.rate(empty, model), pii.detect(empty), bpe.encode(empty, decode=True), substring.dedup(empty), simhash.group(empty), packing.pack(empty), langid.fit_and_identify(empty),
        simhash.thin(empty), substring.strip(empty), pii.scrub(empty), quality.keep(empty, model),
    ):
        assert made.count() == 0


def test_digest_is_of_the_listed_spans():
    assert pii.digest("") == hashlib.sha256(b"").hexdigest()


def test_long_and_joined_identifiers():
    secret = "ab12" * 32
    for cue, found, rest in (("token: ", secret, " end"), ("secret=", "sk_live_51Habc1234XYZ987", "\nx"), ("Token ", "eyJhbGci1.eyJzdWI2.Sf-lK3_wR4", ". Next"), ("account ", "A-123456", ".")):
        text = cue + found + rest
        assert pii.redact(text, pii.find(text, pii.anchors())) == f"{cue}[account]{rest}"


def test_near_copies_among_texts_that_share_a_passage(spark, monkeypatch):
    """Pairs at 0.8 or more among many at 0.78, and groups whose members meet by few links, against all pairs."""
    r = random.Random(6)
    core = " ".join(f"c{i}" for i in range(204))
    texts = []
    for k in range(60):
        tail = [f"t{k}x{i}" for i in range(28)]
        for n in range(2):
            texts.append(core + " " + " ".join([*tail[:10], *(f"{w}n{n}" for w in tail[10:])]))
    base = [f"b{i}" for i in range(100)]
    for k in range(60):
        edited = list(base)
        for at in r.sample(range(100), r.choice([1, 2])):
            edited[at] = f"e{k}"
        texts.append(" ".join(edited))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    fps = [brute.simhash(t) for t in texts]
    assert len(set(fps)) == len(fps) and 60 < len(near) < 1700

    def groups(pairs):
        lead = {f: f for f in fps}
        for a, b in pairs:
            low, high = sorted((lead[a], lead[b]))
            lead = {f: low if x == high else x for f, x in lead.items()}
        return lead

    expected = groups((fps[i], fps[j]) for i, j in near)
    assert len(set(expected.values())) > 60
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for reach in (minhash.REACH, 1):
        monkeypatch.setattr(minhash, "REACH", reach)
        found = [(p.a % 2**64, p.b % 2**64) for p in minhash.links(docs).collect()]
        assert groups(found) == expected


def test_pairs_that_only_share_a_passage_carry_no_sets(spark, monkeypatch):
    """Half of two texts is shared and rare, so they meet; their other halves are common, which prefixes and places don't tell."""
    counts, write = {}, minhash.materialize

    def counted(df, name):
        out = write(df, name)
        counts.setdefault(name, out.count())  # of the first round
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    part = lambda name: " ".join(f"{name}w{i}" for i in range(40))
    texts = [f"{part(f's{k // 2}')} {part(f'u{k}')}" for k in range(8)]
    texts += [f"{part(f'u{k}')} {part(f'o{k}n{n}')}" for k in range(8) for n in range(3)]
    assert minhash.links(spark.createDataFrame([(t,) for t in texts], "text string")).count() == 0
    assert counts["met"] >= 4 and counts["sets"] == 0


def test_crowds_cost_a_row_only_where_a_pair_can_be_near(spark, monkeypatch):
    """Three crowds of 120 whose sets share 0.6 or less of rare shingles and hold two links each, in blocks of 16; against all pairs."""
    rows, write = {}, minhash.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    words = lambda kind, n: " ".join(f"{kind}w{i}" for i in range(n))
    texts = []
    for c in range(3):
        crowd = [f"{words(f'c{c}', 90)} {words(f'o{c}k{k}', 30)}" for k in range(120)]
        texts += [*crowd, *(f"{t.rsplit(' ', 3)[0]} x{c} y{k} z" for k, t in enumerate(crowd[:2]))]
    core = {" ".join(w[i : i + 5]) for t in texts[::122] for w in [t.split()[:90]] for i in range(86)}
    rare = np.concatenate([minhash.shingles(t.encode(), minhash.shingle_values(t.encode(), 3)) for t in sorted(core)])
    levels = np.full(minhash.BINS, 255, dtype=np.uint8)
    levels[(rare >> np.uint64(65 - minhash.BINS.bit_length())).astype(np.int64)] = 0
    monkeypatch.setattr(minhash, "commonness", lambda _: levels)
    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(minhash, "BLOCK", 16, raising=False)

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    fps = [brute.simhash(t) for t in texts]
    near = {tuple(sorted((fps[i], fps[j]))) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    found = {tuple(sorted((p.a % 2**64, p.b % 2**64))) for p in minhash.links(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(near) == 6 and found == near
    assert rows["split"] > 0 and rows["met"] + rows["possible"] < 60 * len(texts)


def test_a_shared_passage_stays_out_of_prefixes_in_a_larger_corpus(spark):
    """Three texts share a tenth of their shingles; a million others fall into the same bins."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(64))
    texts = [" ".join(str(r.getrandbits(40)) for _ in range(600)) for _ in range(1800)]
    shared = [f"{passage} {t}" for t in texts[:3]]
    levels = minhash.commonness(spark.createDataFrame([(t,) for t in [*texts[3:], *shared]], "text string"))
    values = lambda t: minhash.shingles(t.encode(), minhash.shingle_values(t.encode(), 3))
    for t in shared:
        assert not np.isin(minhash.prefix(values(t), levels, 0.8), values(passage)).any()


def test_parities_keep_every_near_pair(spark):
    r = np.random.default_rng(2)
    rows = []
    for n in (1, 5, 63, 64, 65, 100, 128, 129, 255, 257, 600, 3000):
        for common in {n, -(-8 * n // 9), -(-9 * n // 10)}:
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            for more in {n - common, max(0, int(common / 0.8) - n)}:
                b = np.concatenate([a[:common], r.integers(0, 2**64, more, dtype=np.uint64)])
                rows.append((len(a), len(b), minhash.parity(a).tolist(), minhash.parity(b).tolist(), bool(common >= 0.8 * (n + more))))
    pairs = spark.createDataFrame(rows, "nx long, ny long, px array<long>, py array<long>, near boolean")
    assert pairs.where("near").count() > 30
    assert pairs.where("near").where(f"not ({minhash._possible(0.8)})").count() == 0


def test_texts_asked_for_are_all_kept(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FILTER", minhash.PAGE * 2)
    d = spark.range(3000).selectExpr("xxhash64(id) as body", "string(id) as text")
    asked = d.where("text % 7 = 0").select("body").unionByName(spark.createDataFrame([(5,), (-1,), (2**63 - 1,), (-(2**63),)], "body long"))
    assert sorted(int(r.text) for r in minhash._among(d, asked).collect()) == list(range(0, 3000, 7))


def test_quality_learns_from_all_labels(spark):
    """More trusted rows than 8,192, and both they and the threshold count whole; against plain counts."""
    rows = [(i, f"t{i * 7919 % 9973} word") for i in range(9000)]
    docs = spark.createDataFrame([*rows, (9000, "other text here"), (3, "twice"), (None, "none")], "doc_id long, text string")
    labels = spark.range(9000).selectExpr("int(id) as doc_id", "1 as quality").unionByName(spark.createDataFrame([(9000, 0)], "doc_id int, quality int"))
    model = quality.fit(docs, labels)
    trusted = np.concatenate([quality.buckets(t.encode()) for t in [*(t for _, t in rows), "twice"]])
    raw = np.concatenate([trusted, *(quality.buckets(t) for t in (b"other text here", b"none"))])
    a, b = np.bincount(trusted, minlength=quality.BUCKETS), np.bincount(raw, minlength=quality.BUCKETS)
    plain = np.log((a + 0.5) / (a.sum() + 0.5 * quality.BUCKETS)) - np.log((b + 0.5) / (b.sum() + 0.5 * quality.BUCKETS))
    assert np.allclose(model.ratios, plain, rtol=0, atol=1e-12)
    scores = sorted(model.score(t.encode()) for t in [*(t for _, t in rows), "twice"])
    assert model.threshold == scores[9] - 0.1

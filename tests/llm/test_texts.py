"""Problems 7, 8 and 9 against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from siltmark.llm import p7_leaks, p8_mix, p9_spans, tokens
from siltmark.llm.words import words_of
from tests.llm import tables


def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def leaked(documents, items):
    grams = defaultdict(set)
    for i, text in items.items():
        w = words_of(text)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    out = set()
    for d, text in documents.items():
        w = words_of(text)
        for k in range(len(w) - 12):
            out |= {(i, d) for i in grams.get(tuple(w[k : k + 13]), ())}
    return out


def shared(documents, n=300):
    where = defaultdict(set)
    for d, text in documents.items():
        for i in range(len(text or "") - n + 1):
            where[text[i : i + n]].add(d)
    return {(a, b) for own in where.values() for a in own for b in own if a < b}


def test_words():
    assert words_of(None) == words_of("  \n") == []
    assert words_of("> Não,\r\n> o **cartão** <b>de</b> pré​via_2 &amp; 7 px.") == ["nao", "o", "cartao", "de", "previa", "2", "7", "px"]
    assert words_of("café") == words_of("CAFÉ")


def test_p7_small_data(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/eval_passages.parquet").collect()}
    truth = leaked(texts(spark, sf), items)
    assert {tuple(r) for r in p7_leaks.p7_found(spark, sf).collect()} == truth


def test_p7_planted(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice("alfa beta gama delta moldura visor borda calha tela quina faixa grade".split()) + str(rng.randrange(400))
    item = [word() for _ in range(35)]
    filler = lambda n: [word() for _ in range(n)]
    docs = {i: " ".join(filler(120)) for i in range(40)}
    docs[100] = " ".join(filler(70) + item[9:22] + filler(50))  # exactly 13 words
    docs[101] = " ".join(filler(70) + item[9:21] + filler(50))  # 12 words
    docs[102] = " ".join(w.upper() for w in item)
    docs[103] = " ".join(filler(30) + [w for i, w in enumerate(item) if i % 9] + filler(30))  # paraphrase
    docs[104] = "> ".join(f"<i>{w}</i>,\n" for w in item)
    docs[105], docs[106] = None, ""
    docs[107] = " ".join(filler(60_000) + item)  # a very long text
    folder = tables.write(spark, tmp_path, documents=[{"doc_id": i, "text": t} for i, t in docs.items()], eval_passages=[{"item_id": 1, "text": " ".join(item)}, {"item_id": 2, "text": "too short"}, {"item_id": 3}])
    assert {tuple(r) for r in p7_leaks.p7_found(spark, folder).collect()} == {(1, 100), (1, 102), (1, 104), (1, 107)}
    found = {r.doc_id: r for r in p7_leaks.p7_leaks(spark, folder).collect()}
    assert found[100].run == 13 and found[102].run == 35 and found[103].run < 13 and found[103].part >= 0.8


def test_p7_measures():
    a, b = "a b c d e".split(), "x a b y c d e".split()
    assert p7_leaks.common_run(a, b) == 3 and p7_leaks.common_subsequence(a, b) == 5
    assert p7_leaks.common_run(a, []) == 0 and p7_leaks.common_subsequence([], b) == 0


def test_p9_small_data(spark, sf):
    assert {tuple(r) for r in p9_spans.p9_found(spark, sf).collect()} == shared(texts(spark, sf))


@pytest.fixture(scope="module")
def spans(spark, tmp_path_factory):
    rng = random.Random(5)
    letters = "abcdefghij klmnop\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    span, stock = text(300), text(280)
    docs = {i: text(rng.randrange(200, 900)) for i in range(30)}
    docs[50], docs[51] = text(40) + span + text(7), text(333) + span + text(90)
    docs[52] = text(60) + span[:-1] + "#"  # 299 characters
    docs[60], docs[61], docs[62] = (c := text(500)), c, c
    docs[63] = "ç" * 700
    docs[64] = "ç" * 350
    docs[65], docs[66], docs[67] = None, "", "x" * 299
    for i in range(130):  # a stock passage of less than a span, in most documents
        docs[1000 + i] = text(30) + stock + text(60)
    docs[2000] = docs[1000] + text(10)
    return docs, tables.write(spark, tmp_path_factory.mktemp("spans"), documents=[{"doc_id": i, "text": t, "id": 7, "key": "k"} for i, t in docs.items()])


def test_p9_planted(spark, spans):
    docs, folder = spans
    truth = shared(docs)
    assert {(50, 51), (60, 61), (61, 62), (63, 64), (1000, 2000)} <= truth and (50, 52) not in truth
    assert {tuple(r) for r in p9_spans.p9_found(spark, folder).collect()} == truth


def test_p9_parts(spark, spans):
    docs, folder = spans
    rows = {r.doc_id: r for r in p9_spans.p9_shared(spark, folder).collect()}
    assert len(rows) == len(docs)
    covered = {d: set() for d in docs}
    where = defaultdict(set)
    for d, t in docs.items():
        for i in range(len(t or "") - 299):
            where[t[i : i + 300]].add(d)
    for d, t in docs.items():
        for i in range(len(t or "") - 299):
            if len(where[t[i : i + 300]]) > 1:
                covered[d].update(range(i, i + 300))
    partners = defaultdict(set)
    for a, b in shared(docs):
        partners[a].add(b), partners[b].add(a)
    for d, r in rows.items():
        assert (r.n_chars, r.shared_chars, r.partners) == (len(docs[d] or ""), len(covered[d]), len(partners[d])), d
    assert rows[62].first_id == 60 and rows[51].first_id == 50 and rows[52].first_id == 52


def test_p9_hashes():
    chars = p9_spans.characters("abcabcabcX")
    sums = p9_spans.Sums(chars)
    h = sums.grams(3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 4 and len(sums.grams(11)) == 0
    assert sums.between(np.array([3]), np.array([6]))[0] == h[3]


def test_p9_anchors():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c") for _ in range(n)) for n in (299, 300, 301, 900, 2000)] + ["x" * 400]
    found = [set() for _ in texts]
    for _, (owner, offset, first), _, piece, at, _ in p9_spans.passages(texts):
        for p, i in zip(piece.tolist(), at.tolist()):
            found[owner[p]].add(i - first[p] + offset[p])
    for text, own in zip(texts, found):
        h = p9_spans.Sums(p9_spans.characters(text)).grams(p9_spans.PASSAGE)
        windows = [h[j : j + p9_spans.WINDOW] for j in range(len(text) - p9_spans.SPAN + 1)]
        assert own == {j + k for j, w in enumerate(windows) for k in range(len(w)) if w[k] == w.min()}


def test_p9_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    key = lambda: {(i - first[p] + offset[p], *k) for _, (_, offset, first), _, piece, at, keys in p9_spans.passages([text]) for p, i, k in zip(piece.tolist(), at.tolist(), keys.tolist())}
    whole = key()
    monkeypatch.setattr(p9_spans, "PIECE", 700)
    assert key() == whole


def test_p8_small_data(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    encoding = tokens.load_encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    fold = lambda s: "".join(c for c in (s or "").lower() if c not in " _-\t")
    size = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in documents}
    own = defaultdict(int)
    for r in documents:
        own[fold(r.source)] += size[r.doc_id]
    total = sum(own.values())
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").collect()
    assert {r.source for r in p8_mix.p8_found(spark, sf).collect()} == {t.source for t in targets if t.max_repeat * own[fold(t.source)] < t.weight * total}
    mixed = defaultdict(int)
    source = {r.doc_id: fold(r.source) for r in documents}
    for r in p8_mix.p8_mix(spark, sf).collect():
        assert r.tokens == size[r.doc_id] and source[r.doc_id] == fold(r.source)
        mixed[r.source] += r.tokens * r.copies
    largest = max(size.values())
    for t in targets:
        wanted = min(t.weight * total, t.max_repeat * own[fold(t.source)])
        assert wanted - largest <= mixed[t.source] <= wanted + 1e-6, t
    report = {r.source: r for r in p8_mix.p8_report(spark, sf).collect()}
    assert {s: r.mixed for s, r in report.items()} == {t.source: mixed[t.source] for t in targets}
    assert all(r.most_copies <= r.max_repeat for r in report.values())


def test_p8_thresholds_are_exact(spark):
    sized = spark.createDataFrame([(i, "a", 1, (i * 7919) % (1 << 36)) for i in range(2000)] + [(9000 + i, "b", 10, 5) for i in range(3)], "doc_id long, key string, tokens long, draw long")
    at = p8_mix._thresholds(spark, sized, {"a": 777.0, "b": 25.0})
    assert sized.where(f"key = 'a' AND draw < {at['a']}").count() == 777
    assert sized.where(f"key = 'b' AND draw < {at['b']}").count() == 0  # equal draws stay together


def test_degenerate_tables(spark, tmp_path):
    empty = tables.write(spark, tmp_path / "empty")
    blank = tables.write(spark, tmp_path / "blank", documents=[{"doc_id": 1}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": " \n"}], eval_passages=[{"item_id": 1, "text": " ".join(map(str, range(20)))}], mix_targets=[{"source": "lab-wiki", "weight": 1.0, "max_repeat": 2}])
    for folder in (empty, blank):
        assert p7_leaks.p7_found(spark, folder).count() == 0
        assert p9_spans.p9_found(spark, folder).count() == 0
        assert p8_mix.p8_mix(spark, folder).count() == 0
        p8_mix.p8_report(spark, folder).collect()
    assert p9_spans.p9_shared(spark, blank).where("shared_chars = 0 AND shared_part = 0").count() == 3

"""Toxicity, HTML extraction, token files, packing and the pipeline."""

from __future__ import annotations

import html
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import html_extract, packing, token_files, tokens, toxicity
from tidewater.llm.tokens import PieceEncoder, slices

tokenizers = pytest.importorskip("tokenizers")
ODD_TEXTS = ["", " ", "a  b", " a b", "a b ", "a\n b", "a \nb", "a\n\nb c's don't", "<|endoftext|> x", "\0a b", "a b", "é é ́x", "İ ΑΣ Σ", "x\x1c y", "a,, b. c!!' it's", "ab\0 \0. c.", "ﬁ ½ º", "STRASSE Straße"]


# -- toxicity ---------------------------------------------------------------------


def test_toxicity_model_finds_misspellings():
    rng = random.Random(2)
    plain = ["the", "and", "river", "stone", "walked", "under", "evening", "letter", "garden", "window", "morning", "table"]
    bad = ["scoundrel", "vermin", "cretinous"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randrange(10, 60))]
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels, 0.25)
    asked = ["the river and the stone under the garden", "you scoundrel and vermin you", "what a scoundreel and cretinuous table", ""]
    clean, toxic, misspelt, empty = model.scores(toxicity.as_texts(asked))
    assert clean < 0.3 and empty < 0.3 and toxic > 0.6 and misspelt > 0.3


def test_toxicity_without_labels(documents, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(documents, labels)
    assert {r[toxicity.SCORE] for r in toxicity.score_toxicity(documents, model).collect()} == {0.0}
    assert toxicity.score_toxicity(none, model).collect() == []


def test_toxicity_looks_at_repeated_words():
    class Known(toxicity.Model):
        def word_margins(self, words):
            return np.array([-1.0 if w == "fine" else 1.0 for w in words])

    model = Known(np.zeros(toxicity.BUCKETS), 0.0, None, 0.0, 0.1, (-9.0,) * toxicity.TOP)
    bad = [f"bad{k}" for k in range(toxicity.SEGMENT)]
    early = [f"{w} " + "fine " * (toxicity.SEGMENT - 1) for w in bad]
    late, repeated = model.tops(toxicity.as_texts(["".join(early) + " ".join(bad), "bad0 " * toxicity.SEGMENT * toxicity.TOP]))
    assert late[0] == 1.0 and repeated.tolist() == [1.0] * toxicity.TOP


def brute_score(model, text):
    """The score of one text, word by word and n-gram by n-gram."""
    words = text.lower().split()
    margins = []
    for at in range(0, len(words), toxicity.SEGMENT):
        part = words[at : at + toxicity.SEGMENT]
        total = 0.0
        for w in part:
            ids = toxicity.gram_ids([w])[0].tolist()
            total += sum(float(model.margins[i]) for i in ids) / len(ids)
        margins.append(total / max(len(part), toxicity.LEAST_WORDS) + model.bias)
    top = sorted(margins, reverse=True)[: toxicity.TOP]
    top += list(model.floor[len(top) :])
    return 1 / (1 + np.exp(-(np.dot(top, model.slopes) + model.shift)))


def test_toxicity_query_equals_brute_force(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    found = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf_dir).collect()}
    for r in documents.collect():
        assert abs(found[r.doc_id].score - brute_score(model, r.text or "")) < 1e-6


def test_toxicity_ranks_held_out_labels(spark, sf_dir):
    """On the 990 held-out labels of the largest table: 120 are toxic."""
    larger = Path(sf_dir).parent / "sf0.1"
    if not larger.exists():
        pytest.skip("no larger table here")
    labels = spark.read.parquet(f"{larger}/labels.parquet").where("toxic IN (0, 1)")
    asked = spark.read.parquet(f"{larger}/documents.parquet").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    asked = [r for r in asked if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    model = toxicity.fit_toxicity(spark.read.parquet(f"{larger}/documents.parquet"), labels)
    scores, toxic = model.scores(toxicity.as_texts([r.text or "" for r in asked])), np.array([r.toxic == 1 for r in asked])
    assert np.mean(scores[toxic][:, None] > scores[~toxic]) > 0.95
    assert (scores[toxic] >= 0.3).mean() > 0.85 and (scores[~toxic] >= 0.3).mean() < 0.02


def test_toxicity_starts_from_noise():
    """Without joint training the scores say nothing; with it they separate unseen texts."""
    rng, plain = random.Random(3), [f"word{k}" for k in range(300)]

    def text(toxic):
        words = rng.choices(plain, k=40)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(40), rng.choice(["abominable", "wretched"]))
        return " ".join(words)

    labels = [k % 3 == 0 for k in range(600)]
    texts = [text(y) for y in labels]
    trained = toxicity.fit(texts, [int(y) for y in labels], 0.33)
    asked = toxicity.as_texts([text(k % 2) for k in range(400)])
    order = lambda m: np.mean(m.tops(asked)[1::2, :1] > m.tops(asked)[::2, 0])
    noise = toxicity.Model(np.random.default_rng(1).normal(0, 0.1, toxicity.BUCKETS), 0.0, None, 0.0, 0.33)
    assert order(trained) > 0.97 and 0.2 < order(noise) < 0.8


def test_toxicity_fit_takes_2500_of_each_class(spark):
    n = 10_000  # three quarters of them are learned from
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS int) AS toxic")
    sample, prior = toxicity.labelled_sample(docs, labels)
    assert Counter(r.toxic for r in sample.collect()) == {0: 2500, 1: 2500} and 0.4 < prior < 0.6


def test_toxicity_trains_alike_in_a_task_and_on_the_driver(spark, documents, sf_dir):
    sample, prior = toxicity.labelled_sample(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted(sample.collect(), key=lambda r: ((r[0] * 2654435761) % 2**32, r[0], r[1]))
    here = toxicity.fit([r.text for r in rows], [r.toxic for r in rows], prior)
    there = toxicity._fitted(sample, prior)
    assert np.array_equal(here.margins, there.margins) and np.allclose(here.slopes, there.slopes) and here.floor == there.floor


def test_toxicity_gives_up_what_a_worker_holds(monkeypatch):
    """No vocabulary of an earlier task stays, and freed memory goes back after each column and each step of the fit."""
    freed = []
    monkeypatch.setattr(toxicity, "release", lambda collect=True: freed.append(dict(tokens._ENCODERS)))
    model = toxicity.Model(np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS), 0.1, np.full(toxicity.TOP, 0.5), -1.0, 0.1)
    columns = [toxicity.as_texts([" ".join([f"word{k} of column {i}"] * k) for k in range(5)]) for i in range(3)]
    packing.encoder(packing.default_vocabulary(), False)
    assert tokens._ENCODERS
    found = [x.to_pylist() for x in toxicity.scored(model, iter(columns))]
    assert freed == [{}] * len(columns) and found == [model.scores(c).tolist() for c in columns]

    packing.encoder(packing.default_vocabulary(), False)
    freed.clear()
    rows = [(i, i % 2, f"the {'vermin' if i % 2 else 'river'} and stone number {i}") for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "toxic", "text"])
    (made,) = toxicity.fitted_rows(iter([batch]), 0.5)
    assert len(made) == 1 and len(freed) == 4 and not any(freed)


def test_toxicity_sums_in_parts():
    rng = np.random.default_rng(5)
    values, sizes = rng.normal(0, 1, 50), rng.integers(1, 9, 23)
    at = np.concatenate([[0], np.cumsum(sizes)])
    picked = rng.integers(0, 50, at[-1])
    want = np.add.reduceat(values[picked], at[:-1])
    for at_once in (1, 7, 22, 23, 100):
        assert (toxicity._sums(values, picked, at, at_once) == want).all()


def test_toxicity_held_out(spark, documents, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    found = toxicity.score_toxicity(odd, model)
    assert found.count() == odd.count() and all(0 <= r[toxicity.SCORE] <= 1 for r in found.collect())
    left = toxicity.drop_toxic(odd, labels, training=documents)
    assert left.columns == odd.columns
    rows = toxicity.op4_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


# -- HTML -------------------------------------------------------------------------


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.op2_html_extract(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)


def test_html_odd(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<div" * 50 + ">x"), (5, None, "<p>a<p>b"), (1, "u", None), (None, "u", "<div>" * 3000 + "deep" + "</div>" * 2)]
    found = html_extract.extract_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    assert by[1] == by[2] == "" and by[3] == "plain & text"
    assert html_extract.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_html_labelling_is_consistent_and_accurate():
    extractor, rng, good = html_extract.trained(), np.random.default_rng(77), 0
    for _ in range(60):
        page = html_extract.training_page(rng)
        own, truth = html_extract.labelled(page)
        nodes = html_extract.parse(page)
        label = html_extract.decode(nodes, extractor.trees.log_chances(html_extract.features(nodes)), extractor.steps)
        at = {id(n): i for i, n in enumerate(nodes)}
        for i, n in enumerate(nodes[1:], 1):
            above = label[at[id(n.parent)]]
            assert not (above == html_extract.DROP and label[i] != html_extract.DROP)
            assert not (above == html_extract.KEEP and label[i] == html_extract.CONTAIN)
        good += html_extract.text_of(own, truth) == html_extract.text_of(nodes, label)
    assert good >= 48


LOREM = "Rain fell on the harbour all night, and the boats stayed where they were until the morning came."
MORE = "Nobody in the village had seen such water before, not even the oldest of the fishermen who lived there."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body>{LOREM}<br><br>{MORE}<p>{LOREM}</p></body></html>", f"{LOREM} {MORE} {LOREM}"),
        (f"{LOREM} <p>{MORE}</p><p>{LOREM}</p>", f"{LOREM} {MORE} {LOREM}"),
        (f"<html><body>{LOREM}<br>{MORE}</body></html>", f"{LOREM} {MORE}"),
        (f"<article><p>{LOREM} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p><p>{MORE}</p></article>", f"{LOREM} x=2. {MORE}"),
        (f"<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><article>{LOREM}<br><br>{MORE}</article><footer>&copy; 2020 Us</footer>", f"{LOREM} {MORE}"),
        (f"<article><h1>Rain</h1><p>{LOREM}</p><noscript>Enable scripts</noscript><p>{MORE}</p></article>", f"Rain {LOREM} {MORE}"),
    ],
)
def test_html_loose_text_and_formulas(page, text):
    assert html_extract.trained().texts([page]) == [text]


def other_page(rng):
    """A layout of another generator, with names that training has never seen, and its article."""
    say = lambda n: " ".join(rng.choice(LOREM.split()) for _ in range(n)).capitalize() + "."
    paragraphs = [say(rng.randrange(15, 70)) for _ in range(rng.randrange(2, 7))]
    title = say(5)
    body = rng.choice([lambda: "".join(f"<p>{p}</p>" for p in paragraphs), lambda: "<br><br>".join(paragraphs), lambda: "".join(f"<div>{p}</div>" for p in paragraphs)])()
    inside = rng.choice([f"<article><h1>{title}</h1>{body}</article>", f'<div class="zq-leaf k7"><h1>{title}</h1>{body}</div>', f'<main id="vv"><h1>{title}</h1>{body}</main>'])
    links = "".join(f'<a href="/{k}">{say(2)}</a> ' for k in range(rng.randrange(4, 12)))
    top = rng.choice([f"<header>{links}</header>", f'<nav class="qz">{links}</nav>', f'<div class="menu bar9">{links}</div>'])
    end = rng.choice([f"<footer>{say(6)} {links}</footer>", f'<div class="legal footer">{say(4)}</div>', ""])
    side = rng.choice([f"<aside>{say(9)}{links}</aside>", f'<div class="related-k">{links}</div>', ""])
    return f"<!doctype html><html><body>{top}{inside}{side}{end}<script>x=1</script></body></html>", " ".join([title, *paragraphs])


def test_html_layouts_of_another_generator():
    rng = random.Random(12)
    pages = [other_page(rng) for _ in range(200)]
    found = html_extract.trained().texts([p for p, _ in pages])
    share = sum(a == b for a, (_, b) in zip(found, pages, strict=True)) / len(pages)
    assert share >= 0.9, share


def test_html_features_of_many_siblings():
    nodes = html_extract.parse("<body><div>" + "<p>some text</p>" * 60 + "<article>more</article></div></body>")
    stat = html_extract.features(nodes)[:, html_extract._FIRST_STAT :]
    found = [(n.tag, *s[[8, 9, 14]].tolist()) for n, s in zip(nodes, stat, strict=True) if n.tag in ("p", "article")]
    assert found == [("p", k, 61, 1) for k in range(60)] + [("article", 60, 61, 0)]


# -- tokens -----------------------------------------------------------------------


def encoded(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def whole(plain, texts):
    return [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_slices_cover_all_texts():
    texts = pa.array(["a" * n for n in (3, 0, 50, 2, 2, 7, 200, 0)])
    assert list(slices(texts, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7), (7, 8)] and list(slices(texts[:0], 10)) == []


@pytest.mark.parametrize(("path", "joins"), [(token_files.default_vocabulary(), True), (packing.default_vocabulary(), False)])
def test_pieces_equal_whole_texts(documents, path, joins):
    texts = [r.text for r in documents.collect()] + ODD_TEXTS
    plain = tokenizers.Tokenizer.from_file(path)
    encoder = PieceEncoder(path, joins, most=2000)
    for at in range(0, len(texts), 40):
        assert encoded(encoder, texts[at : at + 40]) == whole(plain, texts[at : at + 40])


@pytest.mark.parametrize(("path", "joins"), [(token_files.default_vocabulary(), True), (packing.default_vocabulary(), False)])
def test_every_character_alone_and_beside_punctuation(path, joins):
    """U+0001 to U+2FFF alone, inside words, and before and after punctuation, blanks and line ends."""
    plain, encoder = tokenizers.Tokenizer.from_file(path), PieceEncoder(path, joins, most=20_000)
    shapes = ["{0}", "ab{0}", "{0}ab", "ab{0}, cd", "ab {0}.", "ab,{0}cd", "GEL{0}, gitti!", "ab\n{0}\ncd", "a{0} {0}b", "x\n\n{0}.\n\ny"]
    chars = [chr(c) for c in range(1, 0x3000)]
    for shape in shapes:
        for at in range(0, len(chars), 4000):
            texts = [shape.format(c) for c in chars[at : at + 4000]]
            got, want = encoded(encoder, texts), whole(plain, texts)
            assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize(("path", "joins"), [(token_files.default_vocabulary(), True), (packing.default_vocabulary(), False)])
def test_mixed_scripts_and_spaces(path, joins):
    rng = random.Random(8)
    parts = ["the", "GELDİ", "Straße", "naïve", "ŉ", "слово", "Σίσυφος", "漢字", "e\u0301", "\u0301", "it's", "don't", "42", "x1", "—", "...", "a.b", "\u0130"]
    gaps = [" ", " ", " ", "\n", "\n\n", "  ", "\t", " \n", "\n ", "\r\n", "\u00a0", "\u2003", "\x1c", "\n\n\n", "\0", ""]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", ",", ".", "!?", "'s"]) + rng.choice(gaps) for _ in range(rng.randrange(12))) for _ in range(6000)]
    plain, encoder = tokenizers.Tokenizer.from_file(path), PieceEncoder(path, joins, most=300)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [t for t, a, b in zip(part, encoded(encoder, part), whole(plain, part), strict=True) if a != b] == []


def test_token_file_format():
    rng = np.random.default_rng(3)
    docs = [(i if i != 7 else None, rng.integers(0, 50_000, int(rng.integers(0, 900)), np.uint32).astype("<u4").tobytes()) for i in range(200)]
    sink = io.BytesIO()
    writer = token_files.TokenFileWriter(sink, frame_tokens=2000)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = token_files.TokenFileReader(Source(sink.getvalue()))
    assert list(reader.documents()) == docs
    assert [reader.document(k) for k in (0, 7, 199, 42)] == [docs[k][1] for k in (0, 7, 199, 42)]
    assert len(reader.table) > 10
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert whole.decompress(sink.getvalue()).startswith(b"".join(ids for _, ids in docs))
    broken = bytearray(sink.getvalue())
    broken[reader.starts[1] - 3] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.TokenFileReader(Source(bytes(broken))).documents())


def test_token_files(spark, odd, none, tmp_path):
    path = token_files.default_vocabulary()
    plain = tokenizers.Tokenizer.from_file(path)
    manifest = token_files.write_token_files(odd, path, f"file://{tmp_path}", shards=3, file_tokens=40)
    assert len(manifest) > 5 and sum(m["n_docs"] for m in manifest) == odd.count()
    found = token_files.read_token_files(spark, manifest).collect()
    coded = odd.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr("doc_id", "text", "xxhash64(text) AS h")
    rows = [r[:2] for r in sorted((tuple(r) for r in coded.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))]
    at, want = 0, []
    for doc_id, text in rows:
        ids = np.asarray([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(none, path, f"file://{tmp_path}/none")).collect() == []


# -- packing ----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300])
    counts = {k: rng.choice([0, 1, 2, 5, 50]) for k in range(1, capacity + 1) if rng.random() < 0.5}
    placed, bins = set(), defaultdict(list)
    for length, lo, hi, copies, first, offset in packing.pack_lengths(counts, capacity):
        for k in range(lo, hi):
            assert (length, k) not in placed
            placed.add((length, k))
            bins[first + (k - lo) // copies].append((offset + (k - lo) % copies * length, length))
    assert len(placed) == sum(counts.values())
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 2 * -(-sum(k * n for k, n in counts.items()) // capacity)


def test_packing_bounds_what_a_worker_holds(monkeypatch):
    """Texts are encoded a megabyte at a time, freed memory goes back after each batch, and no id changes."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "Délta"]) for _ in range(20_000)) for _ in range(30)]
    sizes, freed, real = [], [], packing.encoder

    class Spy:
        def encode(self, part):
            sizes.append(sum(len(t.encode()) for t in part.to_pylist()))
            return real(packing.default_vocabulary(), False).encode(part)

    monkeypatch.setattr(packing, "encoder", lambda *_: Spy())
    monkeypatch.setattr(packing, "release", lambda collect: freed.append(collect))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10)), pa.array(texts[k : k + 10])], ["doc_id", "text"]) for k in (0, 10, 20)]
    found = [r for b in packing.cut_pieces(batches, "") for r in b.to_pylist()]
    assert len(freed) == len(batches) and sum(sizes) > 2 << 20 and max(sizes) <= 1 << 20
    plain = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for i, ids in enumerate(whole(plain, texts)):
        ids = np.array([*ids, packing.END_ID], "<u4")
        want += [(i, k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(ids[4096 * k : 4096 * k + 4096].tobytes())) for k in range(-(-len(ids) // 4096))]
    assert [tuple(r.values()) for r in found] == want


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_packing(request, name, none):
    docs = request.getfixturevalue(name)
    plain = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for r in docs.collect():
        ids = np.asarray([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096].tobytes()
            want[r.doc_id, k // 4096, k, len(piece) // 4, zlib.crc32(piece)] += 1
    found = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in found) // 4096) + 1
    assert packing.pack_documents(none).collect() == []


# -- the pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, documents, sf_dir):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    from tidewater.llm.base import materialise

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "test")
        assert docs.columns == documents.columns
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name != "mixing":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_stages_take_odd_rows(spark, odd, none, sf_dir):
    import corpus_pipeline

    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []
        kept[name] = stage(spark, odd, sf_dir)
        if name != "packing":
            assert kept[name].columns == odd.columns
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in kept.items() if name != "packing"}
    every = [(r.doc_id, r.text) for r in odd.collect()]
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    assert set(rows["toxicity"]) <= set(every) and {(4, None), (5, ""), (6, " \n\t ")} <= set(rows["toxicity"])
    largest = {}
    for i, t in every:
        largest[lower(t)] = max(largest.get(lower(t), -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, lower(t)) for i, t in rows["exact_dedup"]) == sorted((i, t) for t, i in largest.items())
    # 1, 2, 3 and 10 are near copies (10 says the text twice: 17 of 20 shingles), and the rows of 2 repeat; nothing else goes.
    gone = {2, 3, 10}
    assert sorted(map(str, rows["near_dedup"])) == sorted(str(x) for x in every if x[0] not in gone)
    times = Counter(i for i, _ in rows["mixing"])
    assert not {4, 5, 6} & set(times) and set(rows["mixing"]) <= set(every)
    assert kept["packing"].where("piece = 0").count() == len(every)

"""Chat formatting, quality rules, licence scans and mixing."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import check
from tidewater.llm import chat_format, licenses, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FORBIDDEN = re.compile("Python|Pandas|Arrow")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- chat formatting ----------------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<\\|end|>", "<\\\\|", "\\", "<", "|>", "<|", "[INST", "[\\/INST]", "<s>", "", "\n", "plain", "é😀<|end|>"]


def test_chat_sql(spark, sf_dir, duck):
    df = chat_format.op1_chat_format(spark, sf_dir)
    assert not FORBIDDEN.search(plan_of(df))
    check(df, duck, chat_format.OP1_SQL)


def test_chat_round_trip(spark):
    rows = [(k, t, role, text) for k, text in enumerate(HOSTILE) for t, role in enumerate(["user", "assistant", text])]
    rows += [(100, None, None, None), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (None, 0, "user", "x")]
    source = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = chat_format.format_chats(source)
    back = {r.conv_id: r for r in found.selectExpr("conv_id", "formatted", "loss_spans", "rounds").withColumn("turns", chat_format.parse(found.formatted)).collect()}
    assert len(back) == len(HOSTILE) + 2
    for k, text in enumerate(HOSTILE):
        r = back[k]
        assert [(t.role, t.text) for t in r.turns] == [("user", text), ("assistant", text), (text, text)]
        body = r.formatted.encode("utf-16-le", "surrogatepass")
        assert len(r.loss_spans) == 1 and body
        points = list(r.formatted)
        raw = "".join(points[r.loss_spans[0].begin : r.loss_spans[0].end])
        assert re.sub(r"([<\[])(\\*)\\(\||/?s>|/?INST\]|</?SYS>>)", r"\1\2\3", raw) == text
    assert back[0].rounds == 1 and back[HOSTILE.index("plain")].rounds == 0
    assert [(t.role, t.text) for t in back[100].turns] == [("", ""), ("assistant", "a"), ("assistant", "a")]


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.format_chats(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|[]\\/sINT> eé", max_size=30))
def test_escape_is_a_bijection(text):
    tail = r"(\||/?s>|/?INST\]|</?SYS>>)"
    escaped = re.sub(r"([<\[])(\\*)" + tail, r"\1\2\\\3", text)
    assert not re.search(chat_format.PLAIN, escaped)
    assert re.sub(r"([<\[])(\\*)\\" + tail, r"\1\2\3", escaped) == text


# -- quality rules --------------------------------------------------------------


def test_quality_sql(spark, sf_dir, duck):
    df = quality.op3_quality_rules(spark, sf_dir)
    assert not FORBIDDEN.search(plan_of(df)) and "Exchange" not in plan_of(df)
    check(df, duck, quality.OP3_SQL)


def brute_metrics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_quality_brute(odd):
    texts = [r.text for r in odd.collect()]
    found = quality.quality_verdicts(odd).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = Counter(brute_metrics(t) for t in texts)
    assert Counter(tuple(r)[:5] for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_empty(none):
    assert quality.quality_verdicts(none).collect() == []


# -- licences ---------------------------------------------------------------------


def test_licenses_brute(documents, odd):
    df = licenses.scan_licenses(documents)
    assert not FORBIDDEN.search(plan_of(df))
    texts = {r.doc_id: r.text for r in documents.collect()}
    hits = 0
    for r in df.collect():
        got = [(x.paragraph, x.family, x.confirmed) for x in r.notices]
        want = [(a, b, e) for a, b, _, _, e in licenses.scan_text(texts[r.doc_id])]
        assert got == want
        hits += len(got)
    assert hits
    assert licenses.scan_licenses(odd).count() == odd.count()


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Released under the MIT License.", "mit"), ("Code: licensed under the Apache License, Version 2.0, see below", "apache"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("He got his driver's license on Monday", None), ("mit der und die", None), ("", None),
    ],
)
def test_license_families(text, family):
    assert [x[1] for x in licenses.scan_text(text) if x[4]] == ([family] if family else [])


def test_licenses_empty(none):
    assert licenses.scan_licenses(none).collect() == []


# -- mixing -----------------------------------------------------------------------


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, passes=2) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if passes * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(passes * sizes[s]) for s in full}
        left -= sum(passes * sizes[s] for s in full)
        open_ -= full
    return target


def check_mix(docs):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    df = mixing.mix_sources(docs)
    found = df.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in found)) == sorted(((i is None, i or 0, s or "", n) for i, s, n in rows))
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    return df


def test_mixing(documents):
    assert not FORBIDDEN.search(plan_of(check_mix(documents)))


def test_mixing_odd(odd, none):
    check_mix(odd)
    assert mixing.mix_sources(none).collect() == []


def test_digest_of_turns_is_that_of_python(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    digests = defaultdict(hashlib.sha256)
    for r in source:
        digests[r.conv_id].update(f"{r.role}\n{r.text}\n".encode())
    for r in chat_format.op1_chat_format(spark, sf_dir).collect():
        if r.conv_id != -1:
            assert r.turns_sha256 == digests[r.conv_id].hexdigest()

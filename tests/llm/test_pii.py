import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

from .conftest import prose

RULES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    found = []
    for kind, rule in enumerate(RULES):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.12 45-+()_%\n", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1(" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_sample(spark, sample):
    rows = {r.doc_id: r for r in pii.op3_skip_chain_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        base = brute(r.text or "")
        got = rows[r.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert got.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(got.spans.split(","))


def test_document_supports_a_mention_the_patterns_miss():
    seen = [f"call +1 ({i}) 555-{i}{j} now or write ab{i}.{j}@mail.example.com today {i * 37}" for i in range(300, 340) for j in range(10, 20)]
    field = pii.Field.train(seen)
    text = "call +1 (412) 555-2426 now, or (412) 555-2426 later; 4711 apples"
    base, spans = field.spans(text)
    assert base == brute(text)
    added = [text[a:b] for a, k, b in spans if (a, k, b) not in base]
    assert added == ["(412) 555-2426"]
    assert pii.redact(text, spans) == "call [PHONE] now, or [PHONE] later; 4711 apples"


def test_edges(spark, edge_docs, no_docs):
    field = pii.train_field(no_docs)
    found = pii.find_pii(edge_docs, field).collect()
    assert len(found) == edge_docs.count()
    assert {r.doc_id: r.redacted for r in found}[1] is None
    assert pii.find_pii(no_docs, field).count() == 0
    assert pii.find_pii(edge_docs, pii.train_field(edge_docs)).count() == edge_docs.count()


def test_marginals_of_a_tree_are_exact():
    """Message passing against the sum over all labellings."""
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    sym = lambda x: (x + x.T) / 2
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)), sym(rng.normal(size=(k, k))), sym(rng.normal(size=(k, k))))
    t = pii.Mentions([0] * 5, [1] * 5, [0] * 5, rng.integers(0, pii.FEATURES, (5, 3)).tolist(), [(0, 1), (1, 2)], [(1, 3), (3, 4)])
    for evidence in ([0] * 5, [0, 0, 2, 0, 0], [1, 0, 0, 0, 4]):
        weight = np.zeros((k,) * 5)
        for y in itertools.product(range(k), repeat=5):
            if all(not e or e == v for e, v in zip(evidence, y, strict=True)):
                score = sum(field.node[t.features[i], y[i]].sum() for i in range(5) if not evidence[i])
                score += sum(field.chain[y[a], y[b]] for a, b in t.chain) + sum(field.skip[y[a], y[b]] for a, b in t.skip)
                weight[y] = np.exp(score)
        exact = np.stack([weight.sum(tuple(j for j in range(5) if j != i)) for i in range(5)])
        got = field.marginals(t, np.array(evidence), 200)
        assert np.allclose(got, exact / exact.sum(1, keepdims=True), atol=1e-3)


def planted(seed, n):
    """Texts with mentions that the patterns miss (a number beside another one), the spans to find, and look-alikes."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while pii.luhn(x := r.choice("3456") + number(15)) != valid:
            pass
        return x

    for i in range(n):
        phone = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        ip = ".".join(str(r.randint(1, 255)) for _ in range(4))
        a, b, bad = card(True), card(True), card(False)
        parts, want = [(f"{prose(i, 20)} ", None), (phone, "phone"), (f" {ip} {prose(i + 1, 20)} ", None), (a, "card"), (" ", None), (b, "card"), (f" {prose(i + 2, 10)} order {number(9)} {bad}! version 3.12.1 in {number(4)} {bad}! and {bad}", None)], []
        text = ""
        for x, kind in parts:
            if kind:
                want.append((len(text), pii.KINDS.index(kind), len(text) + len(x)))
            text += x
        yield text, want


def test_precision_and_recall_of_added_spans():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    field = pii.Field.train([t for t in docs if t and len(t) < 20_000 and re.search("[0-9@]", t)][: pii.TRAIN_DOCS])
    right = wrong = missed = 0
    for text, want in planted(1, 200):
        base, spans = field.spans(text)
        added = {s for s in spans if s not in base}
        right += len(added & set(want))
        wrong += len(added - set(want))
        missed += len(set(want) - set(spans))
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_places_beside_many_overlapping_spans():
    """However many base spans begin before it, a mention that one of them covers is not a mention of its own."""
    text = "+1 2 3 4 5 6 7 8 9 0 1 12.12.12.12 " + " ".join(["1.1.1.1"] * 30)
    base = pii.base_spans(text)
    got = pii.places(text, base)
    assert len(base) > 20 and not any(label == 0 and any(a < e and s < b for s, _, e in base) for a, label, b in got)


def test_numbers_throughout_a_long_text():
    field = pii.Field.train(["call +1 (412) 555-2426 now"])
    base, spans = field.spans("12 345 6 " * 60_000)
    assert base == [] and len(spans) < 60_000

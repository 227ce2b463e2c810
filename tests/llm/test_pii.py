"""Operator 1: base patterns against plain regular expressions, the CRF on held-out sentences."""

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import pii


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(pii.digits_of(m.group())) <= 19 and pii.luhn(pii.digits_of(m.group()))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(pii.digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text("1234 .-@+()ab%_0\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 300_000, "@a" * 300_000, "+1(" * 200_000):
        pii.base_spans(text)
    assert time.time() - start < 30


def test_learned_spans_on_unseen_sentences():
    weights, r = dict(pii.train()), random.Random(991)
    hit = wrong = missed = 0
    for _ in range(300):
        text, spans = pii.sentence(r)
        base, found = pii.all_spans(text, weights)
        assert set(base) <= set(found)
        gold = {s for s in spans if not any(b[1] < s[2] and b[2] > s[1] for b in base)}
        added = set(found) - set(base)
        hit, wrong, missed = hit + len(added & gold), wrong + len(added - gold), missed + len(gold - added)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.9


def test_added_spans():
    found = pii.all_spans("call (743) 555-3824 or bob [at] mail [dot] com today", dict(pii.train()))[1]
    assert [k for k, _, _ in found] == ["phone", "email"]


def test_clean_text_stays_clean():
    weights = dict(pii.train())
    for text in ("On 2024-01-31 at 12:30:45 we sold 1,200 units for $13.50 each.", "See pages 10-25, order no. 12345678.", "Meet at noon, look at the dot.", ""):
        assert pii.all_spans(text, weights)[1] == []


def test_query_columns(spark, mini, texts):
    rows = pii.op1_semi_markov_pii(spark, mini).collect()
    assert len(rows) == len(texts)
    by = {(r.doc_id, r.base_sha256) for r in rows}
    for i, t in texts:
        assert (i, hashlib.sha256(pii.written(plain(t or "")).encode()).hexdigest()) in by
    row = next(r for r in rows if r.doc_id == 15)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 0) and "phone:" in row.spans
    assert next(r for r in rows if r.doc_id == 6).spans == ""


def test_redact_keeps_columns(spark, docs, texts):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    row = out.filter("doc_id = 15").first()
    assert row.text == "call <PHONE> or mail <EMAIL>, card <CARD> at <IP>" and row.n_chars == len(row.text) and row.fingerprint == "y"
    assert out.filter("doc_id = 6").first().text is None


def test_mask_of_overlapping_spans():
    assert pii.mask("abcdefgh", [("card", 1, 4), ("phone", 2, 6)]) == "a<CARD>gh"


def test_empty_table(empty):
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def test_long_words_are_masked_whole():
    """Windows end between words: a long domain is one token, and none of it stays."""
    weights = dict(pii.train())
    for text in ("bob (at) " + "a" * 70 + "longdomain.com", "mail ann [at] " + "b" * 200 + " [dot] com", "x" * 300 + " bob [at] mail [dot] com " + "y" * 300):
        (kind, start, end), = pii.all_spans(text, weights)[1]
        assert kind == "email" and text[start:end].endswith("com") and text[start:].startswith(("bob", "ann"))
    assert pii.mask(text, pii.all_spans(text, weights)[1]) == "x" * 300 + " <EMAIL> " + "y" * 300


def test_windows_take_linear_time():
    start = time.time()
    for text in (("x1234" + "y" * 100) * 5_000, "a" * 500_000 + "1234" + "b" * 500_000, "1 2 3 4 " * 60_000):
        found = pii.windows(text)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
    assert time.time() - start < 20


def segmentations(segments):
    """Every set of disjoint candidates, in order."""
    def go(at, taken):
        yield list(taken)
        for n, (i, j, _, _) in enumerate(segments.found):
            if i >= at:
                yield from go(j, [*taken, n])
    return go(0, [])


def test_dynamic_programs_against_all_segmentations():
    import math

    r = random.Random(3)
    segments = pii.Segments("123 456 7890 or 555 123 4567", 0, 28, [])
    assert 3 <= len(segments.found) <= 40
    scores = [r.uniform(-2, 2) for _ in segments.found]
    moves = [[r.uniform(-1, 1) for _ in pii.STATES] for _ in pii.STATES]

    def value(chosen):
        states = ["none", *(segments.found[n][2] for n in chosen)]
        return sum(scores[n] for n in chosen) + sum(moves[pii.STATES.index(a)][pii.STATES.index(b)] for a, b in zip(states, states[1:], strict=False))

    every = list(segmentations(segments))
    assert value(segments.best(scores, moves)) == max(map(value, every))
    whole = sum(math.exp(value(c)) for c in every)
    chances, expected = segments.marginals(scores, moves)
    for n in range(len(segments.found)):
        assert abs(chances[n] - sum(math.exp(value(c)) for c in every if n in c) / whole) < 1e-9
    assert abs(sum(map(sum, expected)) - sum(math.exp(value(c)) * len(c) for c in every) / whole) < 1e-9


def test_numbers_and_prose_of_other_kinds_stay_clean():
    weights = dict(pii.train())
    for text in (
        "ISBN 978-0-306-40615-7", "see ISBN 0-306-40615-2 for more", "ISBN-13: 978-3-161-48410-0", "invoice INV-20240031", "invoice 2024-031-5512", "order 114-3941689-8772232 came",
        "mail me at home dot com", "write us at noon dot", "they were at rest dot and", "ISSN 2049-3630", "part no 555-010-9921"):
        assert pii.all_spans(text, weights)[1] == [], text
    for text in ("call (743) 555-3824", "mail bob at example dot com now", "phone 743-555-3824", "ip 10 . 0 . 0 . 7"):
        assert len(pii.all_spans(text, weights)[1]) == 1, text


def test_spans_added_in_the_corpus_are_shaped_like_personal_data(spark, sf_dir):
    """Precision outside the generator: what the model adds to the base spans of ``documents``."""
    weights, added = dict(pii.train()), []
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect():
        base, spans = pii.all_spans(r.text or "", weights)
        added += [(k, r.text[a:b]) for k, a, b in spans if (k, a, b) not in set(base)]
    good = [pii.luhn(pii.digits_of(t)) if k == "card" else 7 <= len(pii.digits_of(t)) <= 15 if k == "phone" else True for k, t in added]
    assert not added or sum(good) >= 0.9 * len(good)

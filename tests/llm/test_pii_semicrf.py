"""Base spans against the plain patterns; the semi-Markov model against enumeration; held-out spans."""
import itertools
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from paylake.llm import common, pii_semicrf as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        t = [int(c) for c in reversed(s)]
        return (sum(t[::2]) + sum(sum(divmod(2 * d, 10)) for d in t[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0149.@+-% ()é\n25", max_size=60))
def test_base_equals_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_base_cases_and_long_runs():
    for t in ("a@b.c", "a@b@c.de", "x.@y..z a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.0255", "4111 1111-1111 1111", "4111  1111",
              "+1 (743) 555-3824 x", "+1++23456789", "٣٤", "a@b.c@d.e", "+12345678 (", "4111111111111111111111"):
        assert P.base_spans(t) == plain(t)
    long_ = "a" * 200_000 + " " + "1" * 200_000 + " " + "+1 " * 1000 + "@" * 50_000 + "1." * 50_000
    assert isinstance(P.spans_of(long_, P.SemiMarkov()), tuple)


def test_sums_equal_enumeration():
    rng = np.random.default_rng(0)
    tokens, model = 5, P.SemiMarkov(pairs=rng.normal(size=(6, 6)))
    table = {}
    for i in range(tokens):
        for n in range(1, min(P.MOST_TOKENS, tokens - i) + 1):
            table[i, n] = ([], [float(x) if y or n == 1 else -np.inf for y, x in enumerate(rng.normal(size=6))])

    def every(at):
        if at == tokens:
            yield []
        for n in range(1, min(P.MOST_TOKENS, tokens - at) + 1):
            for y in range(6):
                if y or n == 1:
                    for rest in every(at + n):
                        yield [(at, n, y)] + rest

    z, marg = 0.0, {}
    for seg in every(0):
        w = np.exp(sum(table[s, n][1][y] for s, n, y in seg) + sum(model.pairs[a, b[2]] for a, b in zip([0] + [x[2] for x in seg], seg)))
        z += w
        for s in seg:
            marg[s] = marg.get(s, 0) + w
    _, _, logz = model.sums(tokens, table)
    assert np.isclose(np.log(z), logz)
    got = model.marginals(tokens, table)
    for (s, n, y), w in marg.items():
        assert np.isclose(got[s, n][y], w / z)
    assert list(itertools.islice(every(0), 1))


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    out = P.op6_pii(spark, sf).collect()
    assert len(out) == len(docs)
    secrets = found = extra = 0
    for r in out:
        text = docs[r.doc_id]
        base = plain(text)
        assert r.base_sha256 == P.digest(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b[0] for b in base) for k in P.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert set(P.joined(base).split(",")) - {""} <= set(spans)
        want = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}
        secrets += len(want)
        found += len(want & set(spans))
        extra += len(set(spans) - want - set(P.joined(base).split(",")))
    assert secrets and found / secrets > 0.9 and extra <= 0.02 * len(out)


def test_odd_rows(spark):
    model = P.fit([])
    rows = [(1, None), (2, ""), (None, "mail a.b@c.de now"), (2, "call +1 (743) 555-3824"), (2, "call +1 (743) 555-3824"), (5, "é𝄞 x@y.zz " * 3000)]
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in rows], "doc_id long, text string, base string, spans string")
    got = P.detect(df.drop("base", "spans"), model, ["doc_id"]).collect()
    assert len(got) == len(rows) and {r.base for r in got if r.doc_id is None} == {"email:5:13"}
    assert {r.redacted for r in got if r.base.startswith("phone")} == {"call <PHONE>"}
    assert P.detect(df.filter("false"), model, ["doc_id"]).collect() == []
    assert len(P.detect(df.drop("base", "spans"), P.train(df), ["doc_id"]).collect()) == len(rows)


def test_rare_shapes_are_learned_beside_many_islands_without_entities():
    # 600 lists of features without an entity, 40 different ones with a secret
    rng = np.random.default_rng(3)
    none = ["see " + ".".join("123456789"[:int(k)] for k in rng.integers(1, 10, 5)) + "x" for _ in range(600)]
    keys = ["token " + "".join(rng.choice(list("abcdef0123456789"), 24 + 2 * i)) for i in range(40)]
    assert len({tuple(P.features(t, k[0], k[0], 1)) for t in none + keys for k in P.islands(t)}) > 500
    model = P.fit(none + keys)
    new = "token " + "".join(rng.choice(list("abcdef0123456789"), 45))
    assert [s[0] for s in P.spans_of(new, model)[1]] == ["secret"]
    assert not P.spans_of("see 12.1234.123456.12.1x", model)[1]


def test_a_bounded_sample_keeps_every_kind(monkeypatch):
    cases = [(bytes([i % 256, i // 256]), [None], [(0, 1, 5 if i % 100 == 0 else 0)], "") for i in range(1000)]
    kept = P.chosen(cases, 30)
    assert len(kept) == 30 and sum(c[2][0][2] == 5 for c in kept) == 10
    assert P.chosen(cases, 1000) == cases
    want = [(i, 1, 0) for i in range(60)] + [(60, 10, 3)] + [(i, 1, 0) for i in range(70, 150)]
    parts = list(P.pieces(want))
    assert [(a, n) for a, n, _ in parts] == [(0, 70), (70, 64), (134, 16)]
    assert [(a + s, n, y) for a, _, part in parts for s, n, y in part] == want


def luhn_card(rng, n):
    head = "".join(rng.choice(list("0123456789"), n - 1))
    return next(head + d for d in "0123456789" if P.luhn(head + d))


def test_long_forms_and_long_islands():
    rng = np.random.default_rng(5)
    card = lambda: " ".join(re.findall("[0-9]{1,4}", luhn_card(rng, 19)))
    texts = [f"paid with {card()} today" for _ in range(60)] + [f"rows {i} of {i * 7} and {i * 3} seen" for i in range(60)]
    model = P.fit(texts)
    near = "4111 1111 1111 1111 113"                    # 4-4-4-4-3, wrong check digit
    assert not P.cards(near)
    assert [s[:1] for s in P.spans_of(f"paid with {near} today", model)[1]] == [("card",)]
    # the same behind 0 to 70 single tokens of one island: no place where it is cut
    only = P.SemiMarkov({(3, "shape=4-4-4-4-3"): 60.0, (0, "n=1"): 1.0, (3, "n=1"): -9.0})
    for before in (0, 44, 58, 60, 61, 62, 63, 64, 70):
        line = "7 " * before + near + " 7" * 30
        assert len(P.islands(line)) == 1
        assert P.spans_of(line, only)[1] == [("card", 2 * before, 2 * before + len(near))]


def test_words_between_belong_to_an_island():
    assert [[t.key for t in k] for k in P.islands("(030) 12 ext 34, see also 5 - 6\nat 7")] == [[True, True, False, True], [True, False, True], [True]]
    text = "call 030 12 ext 34"
    model = P.SemiMarkov({(4, "shape=3-2-2"): 60.0, (0, "between"): 5.0})
    assert P.spans_of(text, model)[1] == [("phone", 5, 18)]
    # no base span is lost in an island, and marginals are those of the table
    tokens = P.islands(text)[0]
    table = {(i, n): (f, list(model.scores(text, tokens, i)[n - 1])) for i in range(len(tokens)) for n, f in P.segments(text, tokens, i)}
    kind, a, b, p = model.decode(text, tokens)[0]
    assert np.isclose(p, model.marginals(len(tokens), table)[0, 4][4])


def test_transitions_are_learned():
    rng = np.random.default_rng(1)
    score, pairs, length = rng.normal(size=(2, 6, P.MOST_TOKENS, 6)), rng.normal(size=(6, 6)), np.array([6, 4])
    score[:, :, 1:, 0] = -np.inf
    for i, n in enumerate(length):
        for s in range(6):
            score[i, s, max(n - s, 0):] = -np.inf
    got = P.Sums(score, length, pairs).transitions(pairs, np.array([1.0, 2.0]))
    for a, b in np.ndindex(6, 6):
        step = np.zeros((6, 6))
        step[a, b] = 1e-5
        z = (P.Sums(score, length, pairs + step).z - P.Sums(score, length, pairs - step).z) / 2e-5
        assert np.isclose(got[a, b], z @ [1.0, 2.0], atol=1e-6)
    # an address is followed by a port, never by another address
    model = P.fit([f"from 10.0.{i}.7 {8000 + i} to" for i in range(50)] + [f"in {1900 + i} we" for i in range(50)])
    assert model.pairs[2, 0] > 0 > model.pairs[2, 2]


def other_form(kind, span, pick):
    """Ways of writing a span that training never shows."""
    groups = re.findall("[0-9]+", span)
    if kind == "email":
        name, _, host = span.rpartition("@")
        return (f"{name}{{@}}{host}", f"{name}<@>{host}")[pick % 2]
    if kind == "ip":
        return ("{.}", "[dot]")[pick % 2].join(groups)
    if kind == "card":
        digits = "".join(groups)
        return ("_", ":", " / ")[pick % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return ("00" + "-".join(groups), f"[{groups[0]}] " + " ".join(groups[1:]), "_".join(groups))[pick % 3]


def test_held_out_near_forms_are_found():
    """Base spans of texts that weren't in training, in separators and brackets that
    training never had.  Measured: recall 0.80, precision 1.0 with this small sample (0.92 and
    0.98 with 1,500 texts of a larger table); few plain numbers are taken for personal data."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").to_pylist()
             if t and len(t) <= 20_000 and re.search("[0-9@]", t)]
    model = P.fit(texts[::2][:1500])
    hit = found = total = wrong = plain_numbers = 0
    for text in texts[1::2][:900]:
        for k, (kind, a, b) in enumerate(P.base_spans(text)):
            head, tail = text[max(0, a - 40):a], text[b:b + 40]
            near = other_form(kind, text[a:b], k)
            lo, hi = len(head), len(head) + len(near)
            base, spans = P.spans_of(head + near + tail, model)
            if any(x < hi and y > lo for _, x, y in base):
                continue
            added = [s for s in spans if s not in base and s[0] != "secret"]
            total += 1
            found += len(added)
            hit += any(s[0] == kind and s[1] >= lo - 1 and s[2] <= hi + 1 and s[2] - s[1] >= 0.8 * (hi - lo) for s in added)
            plain_text = head + P.plain_number(text[a:b], k + 1) + tail
            base, spans = P.spans_of(plain_text, model)
            plain_numbers += 1
            wrong += len(spans) > len(base)
    assert total > 200 and hit / total >= 0.75 and hit / found >= 0.95, (hit, found, total)
    assert wrong <= 0.02 * plain_numbers, (wrong, plain_numbers)


def test_near_forms_are_no_base_spans():
    for kind, span in (("email", "a.b@c.de"), ("ip", "10.0.25.1"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (743) 555-3824"), ("phone", "+4930123456")):
        assert P.base_spans(span) and P.base_spans(span)[0][0] == kind
        for pick in range(4):
            assert not any(b - a >= len(span) - 2 for _, a, b in P.base_spans(P.near_form(kind, span, pick)))
            assert not P.base_spans(P.plain_number(span, pick))

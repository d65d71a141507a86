import re

from sparkpanel.llm import pii

from llm.conftest import row_texts, odd_rows

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, rule in BASE.items():
        for m in rule.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


TRICKY = ["a@b a@b.c @x.y a@@b.c. x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1+2 (555) 010-0000 +12345678 +1234567890123456",
          "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111", "é@a.b a.b@c-d.e-f.g 12.34", "9" * 5000, "x" * 5000 + "@a.b",
          "1." * 2000, "+" * 500 + "1 2 3 4 5 6 7 8 9", "a@b.c1.2.3.4", "a@b..c a@.b", "1.2.3.4@5.6.7.8"]


def test_base_spans_are_the_plain_rules(corpus_rows):
    for text in TRICKY + [t for _, t in corpus_rows] + [t for _, t in row_texts(odd_rows())]:
        assert pii.base_spans(text) == plain(text)


def spans(rows, name="spans"):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r[name]] for r in rows}


def test_corpus(corpus, corpus_rows):
    rows = pii.personal_data(corpus).collect()
    assert spans(rows, "base") == {d: plain(t) for d, t in corpus_rows}
    assert all(set(b) <= set(spans(rows)[d]) for d, b in spans(rows, "base").items())


def test_patterns_reveal_unseen_identifiers(spark):
    """Seeds after 'customer card' teach the pattern; a number after it that fails the checksum is found, one elsewhere is not."""
    from random import Random

    rng, texts = Random(5), []
    while len(texts) < 30:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if plain_luhn(digits):
            texts.append(f"note {len(texts)} says customer card {digits} was used once")
    texts += ["later the customer card 4000123412341235 was used once", "part no 4000999912341235 is out of stock"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(pii.personal_data(docs).collect())
    assert [k for k, *_ in got[30]] == ["card"] and texts[30][got[30][0][1]:got[30][0][2]] == "4000123412341235"
    assert got[31] == []
    hidden = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert hidden[30] == "later the customer card <CARD> was used once" and hidden[31] == texts[31]


def found(text):
    return [text[a:b] for a, b in pii.candidates(text, pii.base_spans(text))]


def test_candidates():
    assert found("the customer card 4000 1234 1234 1235, then") == ["4000 1234 1234 1235"]
    assert found("call (555) 010-9999 now") == ["(555) 010-9999"]
    assert found("mac 00:1A:2B:3C:4D:5E. v6 2001:db8:85a3::8a2e:370:7334") == ["00:1A:2B:3C:4D:5E", "2001:db8:85a3::8a2e:370:7334"]
    assert found("user:id=12345678; joe@localhost (a@b) @x y@") == ["12345678", "joe@localhost", "a@b"]
    assert found("mail a@b.c and 10.1.2.3 or 4111 1111 1111 1111") == []
    assert found("no 12 34, year 1999") == ["12 34", "1999"] and found("") == [] and found("12\n34") == []
    assert found("10.1.2.3 99999") == ["99999"]  # the run meets an address
    for long in ("a" * 10**6 + "1234", "1 " * 10**6, "9" * 10**6 + "x", "a:" * 10**5 + "1234", "1234 " * 10**5 + "x", "(" * 10**5 + "1234"):
        assert isinstance(found(long), list)


def test_patterns_reach_over_long_gaps():
    text = "my customer card" + " " * 500 + "number=12345678" + "\n" * 300 + "was lost"
    start = text.index("12345678")
    assert pii.Words(text).patterns(start, start + 8) == ["glued number=", "before customer card", "around card _ was"]
    text = "x" * 1000 + " card " + "1234"
    assert pii.Words(text).patterns(len(text) - 4, len(text)) == ["before " + "x" * 80 + " card"]


def plain_bootstrap(seen, rules):
    """{value: kind} by dictionaries; ``seen`` holds (value, kind or None, pattern)."""
    from math import log

    seeds, at = {}, {}
    for value, kind, pattern in seen:
        if kind:
            seeds[value] = max(kind, seeds.get(value, kind))
        at.setdefault(pattern, {})
        at[pattern][value] = max(kind or "", at[pattern].get(value, ""))
    found, met = {}, []
    while True:
        known = {**found, **seeds}
        accepted = []
        for pattern, values in at.items():
            for kind in {known[v] for v in values if v in known}:
                n = sum(known.get(v) == kind for v in values)
                if n >= rules.support and n >= rules.share * len(values):
                    accepted.append((pattern, kind, 1 - n / (len(values) + 1)))
        doubt = {}
        for pattern, kind, wrong in accepted:
            for value, seed in at[pattern].items():
                if not seed:
                    doubt[value, kind] = doubt.get((value, kind), 0) + log(wrong)
        best = {}
        for (value, kind), d in doubt.items():
            if d <= log(rules.doubt):
                best[value] = min(best.get(value, (d, kind)), (d, kind))
        now = {v: k for v, (_, k) in best.items()}
        if now in met or not now:
            return now
        found = now
        met.append(now)


def chained_texts():
    """Seeds teach one context, what it reveals teaches the next, over more rounds than five."""
    texts = []
    for level in range(8):
        for i in range(14):
            value = f"4{level}{i:02d} 77{i:02d} 999{i % 10}" if level else f"192.168.{i}.7"
            for k in "abcdefghi"[level:level + 2]:
                texts.append(f"alpha{k} beta{k} {value} end{k}")
    return texts + ["alphai betai 5000 1111 2222 other", "unknown words 5000 1111 2223 here"]


def test_scoring_against_dictionaries(spark):
    texts = chained_texts()
    seen = [(t[a:b], k, p) for t in texts for base in [pii.base_spans(t)]
            for k, a, b in base + [(None, *c) for c in pii.candidates(t, base)] for p in pii.Words(t).patterns(a, b)]
    for rules in (pii.Bootstrap(), pii.Bootstrap(support=3, share=0.5, doubt=0.3), pii.Bootstrap(support=20)):
        got = pii.bootstrap(spark.createDataFrame(seen, "value string, kind string, pattern string"), rules)
        assert {r.value: r.kind for r in got.collect()} == plain_bootstrap(seen, rules)


def test_the_search_goes_on_to_its_fixed_point(spark):
    texts = chained_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(pii.personal_data(docs, pii.Bootstrap(support=3, share=0.5, doubt=0.3)).collect())
    per_level = [sum(bool(got[2 * (level * 14 + i)]) for i in range(14)) for level in range(8)]
    assert per_level == [14] * 8 and got[len(texts) - 2] == [("ip", 13, 27)] and got[len(texts) - 1] == []


def test_odd_rows(odd, repeated, empty):
    got = spans(pii.personal_data(odd).collect(), "base")
    assert got == {d: plain(t or "") for d, t, *_ in odd_rows()}
    again = pii.personal_data(repeated).collect()
    assert len(again) == 2 * len(got) and spans(again, "base") == got
    assert pii.personal_data(empty).collect() == []
    hidden = pii.masked(repeated)
    assert hidden.columns == repeated.columns and hidden.count() == repeated.count()
    text = {r.doc_id: r.text for r in hidden.collect()}
    assert text[46] == "call <PHONE> or mail <EMAIL> now <IP>, <CARD>" and text[1] is None

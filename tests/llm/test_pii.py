import hashlib
import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import pii

from .texts import EDGE

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            luhn = sum(n - 9 if n > 9 else n for n in twice) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base_of(text):
    return [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, b, _ in pii.find(text) if b]


TEXTS = [
    "mail joe.doe+x@example.co.uk, or a@b", "1.2.3.4.5 and 256.1.1.1 and 010.0.0.001 9.9.9", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +49 (30) 1234-5678 or +1 2", "é 10.0.0.1 ñ a@x.y 5500005555555559",
    "4785380592391139$$$ 152.143.123.131###", "0000000000000000 x",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert base_of(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()é٣", max_size=60))
def test_base_spans_of_anything(text):
    assert base_of(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "span", "value"),
    [
        ("write to joe [at] example [dot] com now", "email", "joe [at] example [dot] com", "joe@example.com"),
        ("joe at example dot com", "email", "joe at example dot com", "joe@example.com"),
        ("joe(at)mail(dot)example.org", "email", "joe(at)mail(dot)example.org", "joe@mail.example.org"),
        ("mail jоe@ехample.com", "email", "jоe@ехample.com", "joe@example.com"),
        ("j​oe＠example．com".replace("．", "．"), "email", "j​oe＠example．com", "joe@example.com"),
        ("host １０.0.0.1", "ip", "１０.0.0.1", "10.0.0.1"),
        ("plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six", "+4930123456"),
        ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
        ("one nine dot one six dot one dot one two", "ip", "one nine dot one six dot one dot one two", "19.16.1.12"),
    ],
)
def test_disguises(text, kind, span, value):
    got = [(pii.KINDS[k], text[s:e], v) for k, s, e, b, v in pii.find(text) if not b]
    assert (kind, span, value) in got


@pytest.mark.parametrize(
    ("text", "kind", "span", "value"),
    [
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1", "192.168.0.1"),
        ("bob@example dot com", "email", "bob@example dot com", "bob@example.com"),
        ("bob (at) example.com", "email", "bob (at) example.com", "bob@example.com"),
        ("at one.two.three.four now", "ip", "one.two.three.four", "1.2.3.4"),
        ("four one one one-one one one one-one one one one-one one one one", "card", "four one one one-one one one one-one one one one-one one one one", "4111111111111111"),
        ("bob＠example.com", "email", "bob＠example.com", "bob@example.com"),
    ],
)
def test_each_transducer_alone(text, kind, span, value):
    assert [(pii.KINDS[k], text[s:e], v) for k, s, e, _, v in pii.find(text)] == [(kind, span, value)]


@pytest.mark.parametrize(
    ("text", "kind", "span", "value"),
    [
        ("to john [@] example.com now", "email", "john [@] example.com", "john@example.com"),
        ("to john @ example . com now", "email", "john @ example . com", "john@example.com"),
        ("to john @ mail.example.com now", "email", "john @ mail.example.com", "john@mail.example.com"),
        ("to john&#64;example.com now", "email", "john&#64;example.com", "john@example.com"),
        ("to john&commat;example&#x2E;com now", "email", "john&commat;example&#x2E;com", "john@example.com"),
        ("to john_at_example_dot_com now", "email", "john_at_example_dot_com", "john@example.com"),
        ("to john-at-example-dot-co-dot-uk now", "email", "john-at-example-dot-co-dot-uk", "john@example.co.uk"),
        ("to john.doe at example.com now", "email", "john.doe at example.com", "john.doe@example.com"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1", "192.168.1.1"),
        ("plus four nine double three zero one triple five two", "phone", "plus four nine double three zero one triple five two", "+4933015552"),
    ],
)
def test_common_disguises(text, kind, span, value):
    assert [(pii.KINDS[k], text[s:e], v) for k, s, e, _, v in pii.find(text)] == [(kind, span, value)]


@pytest.mark.parametrize("text", ["a state-of-the-art polka-dot shop", "look_at_me and dot_product", "met @ noon . Then left", "a@b . Then", "double trouble", "see &#64; and &period;", "stay at home.now and at example.com"])
def test_signs_alone_are_no_identifiers(text):
    assert pii.find(text) == []


def test_positions_of_a_very_long_text_take_eight_bytes():
    text = "x" * 2_000_000 + " joe(at)example(dot)com " + "é" * 2_000_000
    tracemalloc.start()
    got = pii.find(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(text[s:e], v) for _, s, e, _, v in got] == [("joe(at)example(dot)com", "joe@example.com")]
    assert most < 40 * len(text)


@pytest.mark.parametrize("text", ["look at example.com for more", "one two three", "the at (dot) sign", "met at noon dot", "Straße, naïve café", "число 12", "polka dot one at two"])
def test_clean_texts_get_no_spans(text):
    assert pii.find(text) == []


def test_added_spans_never_lie_in_base_ones():
    text = "a@b.com and jоe@b.com, 10.0.0.1 and １0.0.0.1"
    got = pii.find(text)
    base = [g for g in got if g[3]]
    assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, *_ in base} == set(brute(text))
    for k, s, e, b, _ in got:
        assert b or all(k != x[0] or s < x[1] or e > x[2] for x in base)


@pytest.mark.parametrize(
    ("text", "base", "added", "value"),
    [
        ("mail jоe@b.com now", ["e@b.com"], ["jоe@b.com"], "joe@b.com"),
        ("joe@mail.example(dot)com", ["joe@mail.example"], ["joe@mail.example(dot)com"], "joe@mail.example.com"),
        ("jо.ann@b.com(dot)uk", [".ann@b.com"], ["jо.ann@b.com(dot)uk"], "jo.ann@b.com.uk"),
        ("joe@b.com and о", ["joe@b.com"], [], None),
        ("𝐣𝐨𝐞@b.com", [], ["𝐣𝐨𝐞@b.com"], "joe@b.com"),
        ("Ꭺօ@b.com", [], ["Ꭺօ@b.com"], "Ao@b.com"),
        ("call +49 ３０ 1234-5678", [], ["+49 ３０ 1234-5678"], "+49 30 1234-5678"),
    ],
)
def test_identifiers_beyond_base_spans_are_added_whole(text, base, added, value):
    got = pii.find(text)
    assert [text[s:e] for _, s, e, b, _ in got if b] == base
    assert [(text[s:e], v) for _, s, e, b, v in got if not b] == [(a, value) for a in added]


def test_very_large_numbers():
    text = "0" * 5000 + ".1.1.1 and 1.1.1." + "9" * 5000
    assert base_of(text) == [f"ip:0:{5000 + 6}"]


def brute_added(text):
    """Normalise character by character, keep each one's source, look for all kinds, and drop what lies in a base span."""
    plain, source = "", []
    for i, c in enumerate(text):
        for p in pii.PLAIN[c]:
            plain += p
            source.append(i)
    base = [x.split(":") for x in brute(text)]
    out = set()
    for x in brute(plain):
        kind, s, e = x.split(":")
        a, z = source[int(s)], source[int(e) - 1] + 1
        if not any(k == kind and int(u) <= a and z <= int(v) for k, u, v in base):
            out.add((kind, a, z))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aо.＠@-+ 015é٣３\u200b", max_size=50))
def test_lookalikes_like_brute_force(text):
    assert {(pii.KINDS[k], s, e) for k, s, e, b, _ in pii.find(text) if not b} == brute_added(text)


@pytest.mark.parametrize("unit", ["a", "1", "+", "@", ".", " ", "1.", "a@", "a.", "+1", "(", "1 ", "one ", "one", "plus ", " at ", "a at ", "_at_", "a_at_b", "-dot-", " @ ", "@ab . ", "[@]", "&#64;", "double ", "double one ", "a.b at ", "a.", "at c.d ", "ab", " dot ", "a(dot)", "[", "о", "٣", "1.1.1 ", "a@b.c"])
@pytest.mark.parametrize("tail", ["", " x@", "@b.c", "+1", " one(at)b(dot)c"])
def test_time_is_linear(unit, tail):
    text = unit * (100_000 // len(unit)) + tail
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 1.5


def test_table(frame):
    texts = [*TEXTS, *EDGE, "joe at example dot com"]
    df = frame([*enumerate(texts), (None, "a@b.cd"), (0, texts[0])], "")
    rows = pii.find_pii(df).withColumn("listed", pii.listed(F.filter("spans", lambda s: s["base"]))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < len(texts):
            want = ",".join(brute(texts[r["doc_id"]] or ""))
            assert hashlib.sha256(r["listed"].encode()).hexdigest() == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_pii(frame([])).count() == 0
    assert pii.find_pii(frame([(1, "a@b.cd", "s")], ", spans string")).collect()[0]["spans"][0]["value"] == "a@b.cd"

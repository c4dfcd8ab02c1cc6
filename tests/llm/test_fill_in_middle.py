"""Frames, cuts and forms against plain Python, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from docketspark.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text: str, doc_id, seed: int = 42):
    """The contract, by regular expression on the whole text."""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


RNG = random.Random(5)
TEXTS = ["", " ", "a", " a", "a ", "\n\t \x0b", "x" * 5000, "é☃𝔘 " * 700, "a<P>b", "a <S", "<M", "<", "ab <M>", "\x85 \xa0 a", " " * 3000 + "a", *["".join(RNG.choice("ab é☃𝔘 <PSM>\n\t") for _ in range(RNG.randint(1, 400))) for _ in range(150)]]


@pytest.mark.parametrize("limit", [1, 3, 16, 1 << 16])
def test_frames_equal_plain_python(limit):
    codec = fim.Codec()
    for doc_id, text in enumerate(TEXTS):
        made = fim.transform(frames := fim.Frames.of(text.encode(), codec, limit), doc_id, fim.Rates(), codec)
        assert all(len(codec.unpack(x)) <= limit + 3 for x in frames.data)
        got = b"".join(made.output.read(0, made.output.size, codec)).decode()
        assert (frames.units[-1] if frames.units else 0, made.form, made.prefix_chars, made.middle_chars, got) == plain(text, doc_id)
        again = b"".join(b"".join(made.output.read(*r, codec)) for r in fim.restored(made.output, made.form, codec))
        assert again.decode() == text
        assert (frames.chars[-1] if frames.chars else 0) == len(text)


def test_only_frames_that_hold_a_cut_are_decompressed():
    codec = fim.Codec()
    text = ("word " * 40_000).encode()
    frames = fim.Frames.of(text, codec, 1 << 12)
    opened, unpack = [], codec.unpack
    codec.unpack = lambda x: opened.append(x) or unpack(x)
    assert frames.cut(20_000, codec) == (99_999, 99_999)
    assert len(opened) == 1
    out = fim.Frames()
    frames.move(10, 150_000, codec, out)
    assert len(opened) == 3 and out.size == 149_990 and out.data[1] is frames.data[1]


def odd_rows():
    return [*enumerate(TEXTS), (None, "no id at all " * 30), (500, None), (7, TEXTS[7]), (7, "other text of one id")]


def test_operator_on_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, output string, n int")
    made = fim.fill_in_middle(fim.store(docs, frame_bytes=64))
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in fim.texts(made).collect()), key=key)
    assert got == sorted(((k, *plain(t or "", k), t or "") for k, t in rows), key=key)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect()), key=key)
    assert digests == sorted(((x[0], sha(x[5]), sha(x[6])) for x in got), key=key)
    assert fim.digests(fim.fill_in_middle(fim.store(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_rates_hold_over_many_ids():
    forms = [fim.transform(fim.Frames.of(b"a b c d", c := fim.Codec()), k, fim.Rates(seed=1, transformed=30, suffix_first=50), c).form for k in range(4000)]
    assert 0.26 < 1 - forms.count("plain") / 4000 < 0.34
    assert 0.44 < forms.count("spm") / (4000 - forms.count("plain")) < 0.56

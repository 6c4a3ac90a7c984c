"""Helpers of the training-data operators against plain versions, without Spark."""

import hashlib
import io
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafspark.llm import arc, fmindex, langid, mincut, records, rules, simhash
from sheafspark.llm.buffers import ALNUM, SPACED, find_words, hash_words, slices, text_of
from sheafspark.llm.tokens import encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.sampled_from("aAzZ09 éÉßİŉΣ̌́'|<>.,;\t\n\x0b 中-_sd"), max_size=40)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    for member, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        text = text_of(pa.array(texts, pa.string()))
        text = text.lowered() if member is ALNUM else text
        words = find_words(text, member)
        raw = text.data.tobytes()
        found = [raw[a:b] for a, b in zip(words.start, words.end)]
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if member is ALNUM else t or "" for t in texts]
        expected = [re.findall(pattern, t) for t in lower]
        assert found == [w.encode() for ws in expected for w in ws]
        assert words.per_row.tolist() == [len(ws) for ws in expected]
        hashes = hash_words(text, words).tolist()
        assert len({*zip(found, hashes)}) == len({*found}) == len({*hashes})


@given(st.lists(TEXT, min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_token_ids_are_those_of_whole_texts(texts):
    texts = [*texts, "a<|endoftext|>b <|ENDOFTEXT|> it's,'store x|y"]
    tool = encoder(str(WORDS))
    ids, offsets = tool.encode(text_of(pa.array(texts)))
    whole = [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == whole


def test_other_tokenizers_encode_whole_texts():
    tool = encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["two  spaces", "", "é"]
    ids, offsets = tool.encode(text_of(pa.array(texts)))
    assert not tool.by_word and ids.tolist() == [i for t in texts for i in tool.tokenizer.encode(t).ids]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "b" * 50, "", "c"]})
    parts = list(slices(batch, "text", 10))
    assert [r for p in parts for r in p["text"].to_pylist()] == batch["text"].to_pylist() and len(parts) == 3


def test_records_round_trip_and_damage():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9])).tolist() == [0xE3069283]
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 511, 512, 513, 5000])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    raw = b"".join(records.frames(data, offsets))
    payload, spans = records.unframe(raw, sizes)
    assert (payload == data).all() and (spans == offsets).all()
    for at in (3, 9, 40, len(raw) - 1):
        broken = bytearray(raw)
        broken[at] ^= 1
        try:
            records.unframe(bytes(broken), sizes)
        except ValueError:
            continue
        raise AssertionError("damage not seen")


def test_covering_masks_miss_no_pair():
    for free in ((1 << 64) - 1, 0b1011011101, 0b111):
        masks = simhash.covering_masks(free)
        places = [i for i in range(64) if free >> i & 1]
        for pair in itertools.combinations(places, 2):
            flipped = sum(1 << p for p in pair)
            assert any(m & flipped == 0 for m in masks)


def test_fingerprints_by_bits():
    import xxhash

    texts = ["one two three four", "ONE two", "", None, "x", "a b c a b c a b c", " \n"]
    got = simhash.fingerprints(text_of(pa.array(texts, pa.string())))
    for text, value in zip(texts, got.tolist()):
        words = (text or "").lower().split()
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.lists(st.integers(1, 3), min_size=0, max_size=9), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_fm_index_finds_all_occurrences(runs, phrase):
    symbols = np.array([s for run in runs for s in [*run, 0]], np.int64)
    starts = np.cumsum([0, *[len(r) + 1 for r in runs]])[:-1]
    index = fmindex.ShardIndex.of(symbols, 3, starts)
    row = np.zeros((1, 5), np.int64)
    row[0, 5 - len(phrase) :] = phrase
    low, high = index.search(row, np.array([len(phrase)]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(symbols)) if symbols[i : i + len(phrase)].tolist() == phrase]


def test_merged_spans():
    got = fmindex.merge_spans(np.array([1, 0, 1, 1]), np.array([5, 0, 0, 20]), np.array([9, 3, 6, 22]))
    assert [a.tolist() for a in got] == [[0, 1, 1], [0, 0, 20], [3, 9, 22]]


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        lean = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label):
            own = sum(max(v, 0) if not keep else max(-v, 0) for v, keep in zip(lean, label))
            return own + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(mincut.min_cut(lean, edges)) - best) < 1e-9


def test_main_text_of_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="no-ads">
    <header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &amp; B</h1><p>First <b>bold<br>line.<p>Second &eacute;  one is long enough to be seen as prose, surely.</p>
    <div class=ad>Buy now!</div><ul><li>point one</li><li>point two</ul><form>Search <input></form></article>
    <aside>Related</aside><section id="comments"><article><p>Reader says something long enough to look like prose here.</p></article></section>
    <footer>&copy; me</footer></body></html>"""
    assert mincut.main_text(page).split("\n\n") == [
        "A & B", "First bold line.", "Second é one is long enough to be seen as prose, surely.", "point one", "point two",
    ]
    for odd in ("", "<", "plain <b", "<p", "<!--", "<script>", "</p></p>", "<a href='x>y", "<p>x" * 300):
        mincut.main_text(odd)


PROSE = "<p>This paragraph tells the reader something, and it is long enough to be taken for prose.</p>"


def test_wrapped_main_text():
    text = mincut.main_text(PROSE)
    assert text
    both = "\n\n".join([text, text])
    assert mincut.main_text(f"<body><form action=/x><div>{PROSE * 2}</div><nav><a href=/>Home</a></nav></form></body>") == both
    side = '<div class="sidebar"><p>Other things to look at here, which are also told in rather many words.</p></div>'
    assert mincut.main_text(f'<div class="layout has-sidebar"><article>{PROSE * 2}</article>{side}</div>') == both
    more = f'<article>{PROSE}<h2 id="related-work">Related work</h2>{PROSE}<section id="search"><h3>Search</h3>{PROSE}</section></article>'
    assert mincut.main_text(more).split("\n\n") == [text, "Related work", text, "Search", text]
    talk = f'<section id="comments"><article>{PROSE * 3}</article></section>'
    assert mincut.main_text(f'<div class="has-sidebar"><article>{PROSE}</article>{talk}</div>') == text


def test_elements_without_close_tags():
    text = mincut.main_text(PROSE)
    for odd in ('<svg viewBox="0 0 1 1"/>', "<svg>", "<svg><path d=x>", "<math/>", "<object data=x>", "<select>", "<select><option>one", "<noscript>", "<template>"):
        for later in ("", "<svg></svg>", "<select><option>x</select>", "<object></object>"):
            page = f"<article><div>{odd}</div>{PROSE}</article><footer>{later}</footer>"
            assert mincut.main_text(page) == text, (odd, later)
    for odd in ("<svg>", "<select>", "<select><option>one", "<object data=x>", "<math/>"):
        assert mincut.main_text(f"<article>{odd}{PROSE}</article>") == text
    hidden = "<svg><title>no</title><g><text>no</text></g></svg>", "<object><object>no</object>no</object>", "<select><option>no<option>no</select>"
    for inner in hidden:
        assert mincut.main_text(f"<article>{PROSE.replace('the reader', 'the ' + inner + 'reader')}</article>") == text
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert mincut.main_text(f"<article>{PROSE.replace('something', formula)}</article>") == text.replace("something", "x=1")
    for odd in ("<svg><svg>", "</svg>", "<svg", "<select><select></select>", "<object>" * 300, "<object>" * 300 + "</object>"):
        mincut.main_text(odd)


def test_arc_versions_and_conversion():
    for version in (1, 2):
        about = f"{version} 0 me\n{' '.join(arc.ARC_FIELDS[version])}\n".encode()
        http = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\npay\nload"
        raw = arc._arc_header(version, "filedesc://x.arc", "20240101000000", "text/plain", len(about), "x", 0) + about + b"\n"
        raw += arc._arc_header(version, "http://h/a b", "1999", "text/html", len(http), "x", 9) + http + b"\n"
        raw += arc._arc_header(version, "dns:h", "19990102030405", "text/dns", 3, "x", 9) + b"1.2\n"
        for stream in (io.BytesIO(raw), io.BytesIO(arc.deflated(raw))):
            found = list(arc.read_arc(stream))
            assert [arc.warc_type(r) for r in found] == ["warcinfo", "response", "resource"]
            assert found[1].url == "http://h/a b" and found[1].content == http and found[1].version == version
        assert arc.warc_date("1999") == "1999-01-01T00:00:00Z"
        whole = b"".join(arc.deflated(arc.warc_record(r, "x.arc", None)) for r in found)
        back = list(arc.read_warc(io.BytesIO(whole)))
        assert [b for _, b in back] == [r.content for r in found]
        digest = hashlib.sha1(b"pay\nload").hexdigest()
        assert back[1][0]["warc-record-id"] == f"<{arc.record_id(found[1], 'x.arc', digest)}>"


def test_forward_sums_all_segmentations():
    model = langid.pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    text = text_of(pa.array(["the theé"]))
    words = find_words(text, langid.LETTERS)
    rng = np.random.default_rng(2)
    probability = rng.random((model.count, 2)) / model.count
    scores = langid.score_words(text, words.start, words.end, model, probability)
    for k, word in enumerate(("▁the", "▁theé")):
        raw = np.frombuffer(word.encode(), np.uint8)
        edges = model.lattice(raw, np.array([0]), np.array([len(raw)]))
        arcs = {}
        for end, length, _, piece in edges:
            arcs.setdefault(end - length, []).append((end, int(piece[0])))

        def total(at, lang, arcs=arcs, size=len(raw)):
            return 1.0 if at == size else sum(probability[p, lang] * total(to, lang) for to, p in arcs.get(at, []))

        assert np.allclose(scores[k], [np.log(total(0, lang)) for lang in (0, 1)])


def test_rare_pieces_do_not_underflow():
    model = langid.pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    run = "\U0001d41a" * 11 + "a"
    parts = langid.words_of(pa.array([run, "the cat", None, "the dog"]), model)
    text, words = parts.text, parts.words
    rare = 0.05 / 1.2e6
    probability = np.full((model.count, 2), rare)
    scores = langid.score_words(text, words.start, words.end, model, probability)
    assert np.isfinite(scores).all() and (scores[0] < 44 * np.log(rare)).all()
    sums = langid._sums(scores[:, 0], words.first)
    assert np.allclose(sums, [scores[0, 0], scores[1:3, 0].sum(), 0, scores[3:5, 0].sum()])
    flat, begin, sizes = langid.marked(text, words.start[:1], words.end[:1])
    counts = langid.expected_counts(model.lattice(flat, begin, sizes), sizes, np.array([3.0]), probability[:, 0])
    assert np.isfinite(counts).all() and 3 * 45 <= counts.sum() <= 3 * 48


def all_segmentations(raw, known, logs):
    """Log of the sum over all segmentations of the bytes, and whether each place has a piece reaching over it."""
    best = [0.0] + [-np.inf] * len(raw)
    over = np.zeros(len(raw) + 1, bool)
    for end in range(1, len(raw) + 1):
        for start in range(max(0, end - 60), end):
            piece = known.get(raw[start:end])
            if piece is not None:
                best[end] = np.logaddexp(best[end], best[start] + logs[piece])
                over[start + 1 : end] = True
    return best[-1], over


def vocabulary(model_file):
    """Pieces by their bytes, in the order of the file."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=model_file)
    known = {}
    for i in range(tool.get_piece_size()):
        text = tool.id_to_piece(i)
        raw = bytes([int(text[3:5], 16)]) if tool.is_byte(i) else text.encode()
        if not (tool.is_control(i) or tool.is_unknown(i)) and "▁".encode() not in raw[1:]:
            known.setdefault(raw, len(known))
    return known


def test_long_runs_are_summed_whole():
    file = str(public_tokenizers.path("piece_bpe_32k.model"))
    model, known = langid.pieces(file), vocabulary(file)
    rng = np.random.default_rng(3)
    probability = rng.random((model.count, 2)) / model.count
    runs = [
        "responsibilityresponsibilitiesinternationalisation" * 4, "日本語の文章は空白なしに続くので長い" * 6, "ภาษาไทยไม่มีการเว้นวรรคระหว่างคำ" * 5,
        "\U0001d41a" * 60 + "the", "x" * 700, "thethethe" * 90, "é" * 120 + "日本" * 30, "short", "responsibility",
    ]
    parts = langid.words_of(pa.array([*runs, None, "the cat " + runs[1]]), model)
    scores = langid.score_words(parts.text, parts.words.start, parts.words.end, model, probability, parts.bare)
    assert parts.n_words.tolist() == [1] * len(runs) + [0, 3] and (~parts.bare).sum() == parts.n_words.sum()
    for k, run in enumerate(runs):
        raw = b"\xe2\x96\x81" + run.encode()
        a, b = parts.words.first[k], parts.words.first[k + 1]
        for lang in (0, 1):
            want, over = all_segmentations(raw, known, np.log(probability[:, lang]))
            assert np.isclose(scores[a:b, lang].sum(), want, rtol=1e-9), run
        if len(raw) - 3 > langid.LONG:
            cuts = parts.words.start[a + 1 : b] - parts.words.start[a] + 3
            assert not over[cuts].any() and len(cuts) == (~over[4:-1]).sum()
    codes, first = langid.distinct_words(parts)
    assert np.allclose(scores[first[codes]], scores)


def test_measurements_of_rules():
    texts = ["a b " * 10, None, "", "x\n\nx\n x\nx", "é# $ |\n", " ".join("abcdefghi") + " " + " ".join("abcdefgh")]
    got = rules.measure_rows(pa.array(texts, pa.string()))
    assert got["n_words"].tolist() == [20, 0, 0, 4, 3, 17] and got["word_chars"].tolist() == [20, 0, 0, 4, 4, 17]
    assert got["n_repeat_words"].tolist() == [20, 0, 0, 0, 0, 16]
    assert got["n_dup_lines"].tolist() == [0, 0, 0, 2, 0, 0] and got["n_symbols"].tolist() == [0, 0, 0, 0, 3, 0]


SENTENCE = "This is a sentence of the article with some ten or twelve words in it."
OPINION = "I think that this reader comment is really very long and says something else."


def _article(n=10):
    return "".join(f"<p>{SENTENCE} {i}</p>" for i in range(n))


def _talk(n, name="comment"):
    return "".join(f'<div class="{name}"><p>{OPINION} {i}</p></div>' for i in range(n))


@pytest.mark.parametrize("n", [10, 20, 50, 200])
def test_comments_go_and_the_article_stays(n):
    article = "\n\n".join(f"{SENTENCE} {i}" for i in range(10))
    listed = "".join(f'<li><article class="comment-body"><p>{OPINION}</p></article></li>' for _ in range(n))
    pages = [
        f'<div class="post comments-open">{_article()}</div><div id="comments">{_talk(n)}</div>',
        f'<div class="post-comments-enabled">{_article()}</div><div id="comments">{_talk(n, "x")}</div>',
        f'<article>{_article()}<section class="comments">{_talk(n, "x")}</section></article>',
        f'<article>{_article()}</article><div id="comments">{_talk(n, "x")}</div>',
        f'<article>{_article()}</article><ol class="comment-list">{listed}</ol>',
        f'<div class="layout no-comments has-sidebar">{_article()}<div class="reply">{_talk(n, "x")}</div></div>',
    ]
    for page in pages:
        assert mincut.main_text(page) == article, page[:60]
    wrapped = f'<div class="comments"><h1>Title of it</h1>{_article()}</div>'
    assert mincut.main_text(wrapped).endswith(article)


def test_very_long_and_very_deep_pages_take_time_in_proportion():
    import time

    def seconds(page):
        start = time.perf_counter()
        mincut.main_text(page)
        return time.perf_counter() - start

    def pages(n):
        yield "".join(f"<p>{SENTENCE if i % 2 else 'w'}</p>" for i in range(n))
        yield "".join(f"<p>short {i}</p><div><a href=x>link {i}</a></div>" for i in range(n // 2))
        yield "".join(f"<div>w{i} " for i in range(n))
        yield "".join(f'<div class="ad">w{i} some words here ' for i in range(n))
        yield "<b>" * n + "<p>x" * n
        yield "<div>" * n + "</span></p></table>" * n

    for small, large in zip(pages(5_000), pages(20_000)):
        seconds(small)
        assert seconds(large) < 4 * 4 * max(seconds(small), 0.05)


def test_scripts_without_spaces_are_not_too_long():
    chinese, thai = "这是一个没有空格的句子用来测试规则。" * 3, "ภาษาไทยไม่มีการเว้นวรรคระหว่างคำ" * 2
    texts = ["\n".join(f"{chinese}{i}" for i in range(30)), "\n".join(f"{thai}{i}" for i in range(30)), "\n".join("x" * 30 + str(i) for i in range(30)), None]
    got = rules.measure_rows(pa.array(texts, pa.string()))
    assert got["n_unspaced"].tolist() == [30 * 51, 30 * len(thai), 0, 0]
    long = got["word_chars"] - got["n_unspaced"] > 20 * got["n_words"]
    assert long.tolist() == [False, False, True, False] and (got["word_chars"] > 20 * got["n_words"])[:3].all()

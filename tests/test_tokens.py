import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from sheafspark.functions.text import number_lines
from sheafspark.functions.tokens import slices
from sheafspark.functions.tokens import Vocabulary, _counter, line_ends, token_counter
from sheafspark.operators import document, tokens
from sheafspark.operators.entries import entry_xml
from sheafspark.options import BundleOptions
from sheafspark.plans.pack import entries_of, pack
from sheafspark.schemas import FILES
from sheafspark.session import shared_dir

PATTERN = public_tokenizers.PATTERN
END = "<|endoftext|>"
RANKS = Vocabulary("byte_bpe_50k", "tiktoken", public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN, ((END, 50256),))
JSON = Vocabulary("byte_bpe_50k_json", "huggingface", public_tokenizers.path("byte_bpe_50k.json"))
PIECES = Vocabulary("piece_bpe_32k", "sentencepiece", public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", "hello world", "fn main() {\n    println!(\"hi\");\n}\n", "日本語の文章", "Русский текст", "tab\t\t  x\n\n\n"]

# Fixed values: (name, model it stands for).
NAMES = [
    ("gpt5", "gpt5"), ("GPT4o", "gpt4o"), ("gpt4", "gpt4"), ("Gpt3.5", "gpt3.5"), ("deepseek-v4", "deepseek-v4"),
    ("DEEPSEEK-V3", "deepseek-v3"), ("deepseek-r1", "deepseek-r1"), ("DeepSeek", "deepseek-r1"), ("glm5.2", "glm5.2"),
]


def counts(spark, vocabulary, special="all", texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in df.select("i", token_counter(vocabulary, special)(F.col("t")).alias("n")).orderBy("i").collect()]


def test_models_in_any_case(spark):
    requests = spark.createDataFrame([(n,) for n, _ in NAMES] + [("gpt2",), ("gpt3",), ("unknown",)], "model_name string")
    got = {r.model_name: r.model for r in tokens.resolve_models(requests).collect()}
    assert got == dict(NAMES) | {"gpt2": None, "gpt3": None, "unknown": None}
    rows = {r.model_name: r.message for r in tokens.unsupported_models(requests).collect()}
    assert set(rows) == {"gpt2", "gpt3", "unknown"}
    assert all(model[0] in rows["gpt2"] for model in tokens.MODELS)


def test_models_share_vocabularies(spark):
    vocab = {r.alias: r.vocab for r in tokens.models(spark).collect()}
    assert vocab["gpt5"] == vocab["gpt4o"] and vocab["gpt4"] == vocab["gpt3.5"] and vocab["gpt4"] != vocab["gpt5"]
    assert vocab["deepseek"] == vocab["deepseek-r1"] and len(vocab) == 9


def test_missing_vocabulary_is_an_error():
    with pytest.raises(LookupError, match="o200k_base"):
        tokens.vocabulary_for("gpt5", {"cl100k_base": RANKS})
    assert tokens.vocabulary_for("GPT4", {"cl100k_base": RANKS}) is RANKS
    with pytest.raises(ValueError, match="Supported models: gpt5"):
        tokens.vocabulary_for("gpt2", {})


def test_counts_of_the_same_vocabulary_agree(spark):
    ranks, json_counts = counts(spark, RANKS), counts(spark, JSON)
    assert ranks == json_counts and ranks[0] == 0 and ranks[1] == 2
    assert counts(spark, PIECES)[0] == 0


def test_special_tokens_policy(spark):
    text = [f"a{END}b"]
    assert counts(spark, RANKS, "all", text) == counts(spark, JSON, "all", text) == [3]
    assert counts(spark, RANKS, "none", text)[0] > 3 and counts(spark, JSON, "none", text)[0] > 3
    assert counts(spark, RANKS, "all", [None]) == [None]
    with pytest.raises(ValueError):
        token_counter(RANKS, "some")


def test_document_tokens_are_those_of_the_whole_text(spark, make_files):
    contents = {f"d/{i}.txt": t for i, t in enumerate([*TEXTS, "ends blank \n \n", "]]>", f"x {END} y"])}
    rows = document.document_rows(entries_of(make_files(contents), BundleOptions(exclude=())))
    whole = "".join(r.line + "\n" for r in rows.orderBy("section", "sort_key").collect())
    got = tokens.bundle_tokens(rows, RANKS).first().n_tokens
    assert got == _counter(RANKS, "all")([whole])[0]


# A pattern whose punctuation takes the newlines after it along.
JOINING = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
)


def test_document_tokens_of_a_pattern_that_joins_newlines(spark, make_files):
    vocabulary = Vocabulary("joining", "tiktoken", RANKS.path, JOINING, newline="previous")
    contents = {f"d/{i}.txt": t for i, t in enumerate([*TEXTS, "ends blank \n \n", "]]>\n\n"])}
    rows = document.document_rows(entries_of(make_files(contents), BundleOptions(exclude=())))
    whole = "".join(r.line + "\n" for r in rows.orderBy("section", "sort_key").collect())
    assert tokens.bundle_tokens(rows, vocabulary).first().n_tokens == _counter(vocabulary, "all")([whole])[0]


def test_packing_counts_tokens_of_the_model(spark, make_files):
    target = shared_dir(spark)
    packed = pack(make_files({"a": "x y"}), target, BundleOptions(model="gpt4"), {"cl100k_base": RANKS})
    row = packed.metrics.first()
    assert row.model == "GPT-4" and row.n_tokens == tokens.bundle_tokens(packed.rows, RANKS).first().n_tokens
    with pytest.raises(LookupError):
        pack(make_files({"a": "x y"}), shared_dir(spark), BundleOptions(model="gpt5"), {"cl100k_base": RANKS})


def test_comparison_and_overhead(spark, make_files):
    entries = entries_of(make_files({"a": "one two\nthree\n", "b": "x"}), BundleOptions(exclude=()))
    got = {r.vocab: (r.n_files, r.n_tokens) for r in tokens.compare_models(entries, "body", [RANKS, JSON]).collect()}
    assert got["byte_bpe_50k"] == got["byte_bpe_50k_json"] and got["byte_bpe_50k"][0] == 2
    row = tokens.token_overhead(entries, RANKS).first()
    assert row.plain_tokens == got["byte_bpe_50k"][1] < row.numbered_tokens < row.packed_tokens


def test_overhead_is_that_of_the_whole_forms(spark, make_files):
    """Counts taken from the ends of lines are those of whole numbered and packed texts, whatever stands where lines are cut."""
    rng = random.Random(7)
    signs = ["a", "Wort", "é", "日本", "12", "don't", "'s", ".", "]]>", "]]", ">", "<&", " ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\u00a0", "\u2028", "\u0085", END, "\U0001f600"]
    contents = {f"{i}.txt": "".join(rng.choices(signs, k=rng.randrange(1, 60))) for i in range(400)}
    contents |= {"long line": "word " * 2000, "s": "a b c\nd e f", "no space": "x" * 500, **{f"t{i}": t for i, t in enumerate(TEXTS) if t}}
    rows = spark.createDataFrame([(path, path, len(t.encode()), bytearray(t.encode()), None) for path, t in contents.items()], FILES)
    entries = entries_of(rows, BundleOptions(exclude=()))
    forms = entries.where("disposition = 'text'").select(
        "bundle_id", F.col("body"), number_lines(F.col("body")).alias("numbered"), F.concat(F.lit("\n    "), entry_xml()).alias("packed")
    )
    for special in ("all", "none"):
        count = _counter(RANKS, special)
        want = {r.bundle_id: tuple(count([r.body, r.numbered, r.packed])) for r in forms.collect()}
        got = {r.bundle_id: (r.plain_tokens, r.numbered_tokens, r.packed_tokens) for r in tokens.token_overhead(entries, RANKS, special).collect()}
        assert got == want and len(want) > 400


def test_overhead_encodes_the_inside_of_lines_once(spark, make_files, monkeypatch):
    text = "one two three four five six seven\n" * 50
    entries = entries_of(make_files({"a": text}), BundleOptions(exclude=()))
    seen = []

    def counter(vocabulary, special):
        def lengths(column):
            seen.append(column)
            return F.length(column).cast("bigint")

        return lengths

    monkeypatch.setattr(tokens, "token_counter", counter)
    for vocabulary in (RANKS, JSON):
        seen.clear()
        row = tokens.token_overhead(entries, vocabulary).first()
        # Lengths add up as tokens do.
        assert (row.plain_tokens, row.numbered_tokens) == (len(text), len(text) + 50 * len("12  "))
        assert len(seen) == (4 if vocabulary.cuttable else 3)
    ends = spark.createDataFrame([(text,), ("a b]]>c d e\n",), ("",)], "t string").select(line_ends(F.col("t"))).collect()
    assert [r[0] for r in ends] == ["one\n" * 50, "a b]]>c d e\n", ""]


def test_only_known_patterns_are_cut():
    assert RANKS.cuttable and not JSON.cuttable and not PIECES.cuttable
    assert not Vocabulary("x", "tiktoken", RANKS.path, JOINING).cuttable
    assert not Vocabulary("x", "tiktoken", RANKS.path, PATTERN, (("a b", 1),)).cuttable


def test_encoders_get_few_texts_at_a_time():
    """A batch is handed on in runs of bounded bytes; nulls and a text above the bound have their places."""
    texts = pa.array(["a" * 100, None, "b" * 150, "é" * 400, "", None, "c" * 250, "d"])
    parts = [part.to_pylist() for part in slices(texts, 300)]
    assert [t for part in parts for t in part] == texts.to_pylist()
    assert parts == [["a" * 100, None, "b" * 150], ["é" * 400], ["", None, "c" * 250, "d"]]
    assert list(slices(pa.array([], pa.string()), 300)) == []

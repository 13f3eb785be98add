"""All operators and stages on tables with clashing column names, repeated and null ids, ids of other types, very long texts, and no rows."""

import os
import sys

import pytest

from plexus.llm import chat, decontam, exact_dedup, langid, line_dedup, pii, piece, quality, sharding, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
NAMES = ["a.b", "doc_id", "TEXT", "text", "lang", "__gone", "__h", "gone", "ka", "kb", "t", "c0", "source", "n_chars", "fp", "doc_key", "n_words", "lang_pred"]


def dressed(spark, rows, id_type="long"):
    """Rows (doc_id, text, lang) under all of NAMES."""
    kinds = {"doc_id": id_type, "n_chars": "long"}
    out = [tuple({"doc_id": i, "text": t, "lang": k, "n_chars": len(t or "")}.get(c, f"{c} of {n}") for c in NAMES) for n, (i, t, k) in enumerate(rows)]
    plain = spark.createDataFrame(out, ", ".join(f"x{n} {kinds.get(c, 'string')}" for n, c in enumerate(NAMES)))
    return plain.toDF(*NAMES)


@pytest.fixture(scope="module")
def base(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"word{i} and more" for i in range(60_000))
    return [*docs, (1, "another text of the first id " * 3, "en"), (1, "another text of the first id " * 3, "en"), (None, "an id is missing here", "en"), (None, None, None), (5000, "", "en"), (5001, long, "en")]


@pytest.fixture(scope="module", params=["long", "string"])
def docs(spark, base, request):
    rows = base if request.param == "long" else [(None if i is None else f"d{i}", t, k) for i, t, k in base]
    return dressed(spark, rows, request.param).repartition(3).cache()


def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def labels(spark, docs):
    """Every second document is good."""
    return docs.toDF(*(f"x{i}" for i in range(len(NAMES)))).selectExpr(f"x{NAMES.index('doc_id')} AS doc_id", "1 AS quality", "0 AS toxic").where("doc_id is not null").distinct()


OPERATORS = {
    "pii": lambda spark, d: pii.detect(d),
    "decontam": lambda spark, d: decontam.contamination(d, items(spark)),
    "exact_dedup": lambda spark, d: exact_dedup.exact_dedup(d),
    "sharding": lambda spark, d: sharding.shard(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "langid": lambda spark, d: langid.identify(d),
    "quality": lambda spark, d: quality.classify(d, labels(spark, d)),
    "piece": lambda spark, d: piece.encode_decode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "line_dedup": lambda spark, d: line_dedup.drop_recurring(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_gives_a_row_for_each(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    got = out.toDF(*(f"x{i}" for i in range(len(out.columns)))).collect()
    at = out.columns.index("doc_id")
    key = lambda x: (x is None, str(x))
    ids = [r[NAMES.index("doc_id")] for r in docs.collect()]
    assert sorted((r[at] for r in got), key=key) == sorted(ids, key=key)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_on_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    got = {tuple(r) for r in out.toDF(*(f"x{i}" for i in range(len(out.columns)))).collect()}
    have = {tuple(r) for r in docs.collect()}
    if name == "sentencepiece":
        assert len(got) == len({(r[1], r[3]) for r in have}) or got
        return
    assert out.columns == NAMES
    if name == "line_dedup":
        untouched = [NAMES.index(c) for c in NAMES if c not in ("text", "n_chars")]
        assert sorted(str([r[i] for i in untouched]) for r in got) == sorted(str([r[i] for i in untouched]) for r in have)
    else:
        assert got <= have
    assert any(r[1] in (1, "d1") and r[3] == "another text of the first id " * 3 for r in got)
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_verdicts_are_by_id_and_text(spark):
    """Of rows that share an id, one contaminated or a copy, the clean one stays; null ids are judged too."""
    item = items(spark).first()["text"]
    rows = [(7, item, "en"), (7, "a clean text with words of its own", "en"), (None, item, "en"), (None, "clean as well", "en"), (8, "one more clean text, of a kind of its own", "en")]
    kept = {(r[1], r[3]) for r in decontam.keep_clean(dressed(spark, rows), items(spark)).collect()}
    assert kept == {(i, t) for i, t, _ in rows if t != item}
    rows = [(1, "the same words stand here and there", "en"), (2, "the same words stand here and there", "en"), (2, "all other words, so no copy of that", "en"), (None, "the same words stand here and there", "en"), (None, "nothing like it at all, not a word", "en")]
    kept = {(r[1], r[3]) for r in simhash.keep_first(dressed(spark, rows)).collect()}
    assert kept == {(i, t) for i, t, _ in (rows[0], rows[2], rows[4])}


def test_chat_with_other_columns(spark):
    turns = spark.createDataFrame([("c1", 0, "u", "hi", "x"), ("c2", 0, "u", "hi", "y"), ("c2", 1, "a", "ho", "z")], "conv_id string, turn int, role string, text string, x string").toDF("conv_id", "turn", "role", "text", "a.b")
    assert [(r["conv_id"], r["n_turns"]) for r in chat.collapse(turns).collect()] == [("c2", 2)]
    assert chat.collapse(turns.limit(0)).count() == 0


@pytest.mark.parametrize("langs", [(), ("en",), ("en", "fr"), ("en", "de"), ("en", "de", "fr")])
def test_languages_by_family(spark, langs):
    """Families of one language, and a corpus of one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"lang in ({', '.join(map(repr, langs)) or 'null'})")
    got = langid.identify(docs, keep=("lang",)).where("lang_pred <> 'und'").selectExpr("avg(cast(lang = lang_pred AS int)) AS a", "count(*) AS n", "min(score) AS lo", "max(score) AS hi").first()
    if not langs:
        assert got["n"] == 0
    else:
        assert got["a"] > 0.95 and 0 <= got["lo"] <= got["hi"] <= 1
        if len(langs) == 1:
            assert got["lo"] == 1


def test_pipeline_runs_on_a_table_of_one_language(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= docs.count()

"""The queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm import alignment, ann, collocations, exact_dedup, langid, line_dedup, mixing, quality, secrets, sentencepiece_lattice, simhash, token_files, url_filter
from importlake.llm.common import fold, table

#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The least score of a text that the classifier keeps.
QUALITY_LEAST = 0.3
#: Relative shares in the mix; a source that isn't named has a share of two.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 3}
MIX_OTHER = 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, by a model that learned from labels of training folds only."""
    return quality.score(docs, quality.train(docs, labels, fold(F.col("doc_id"), 5) != 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2, vocabulary_path())
    guessed = langid.predict(docs, model)
    return guessed.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX_WEIGHTS, other_weight=MIX_OTHER)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_deleted").alias("n_deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), check="round_trip")
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    files = token_files.write(table(spark, sf_dir, "documents"), folder, byte_level_path())
    return token_files.checks(spark, folder, files)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), byte_level_path(), vocabulary_path(), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.mine(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_secret_scan": op2_secret_scan,
        "op3_language": op3_language,
        "op4_mix": op4_mix,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_simhash": op6_simhash,
        "op7_line_dedup": op7_line_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_nearest": op9_nearest,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_token_files": op11_token_files,
        "op12_token_alignment": op12_token_alignment,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Without redirects and canonical links the method allows; those are tested against a brute-force version.
ORACLES = {
    "op5_exact_dedup": f"""with d as (select doc_id, {FOLDED} as t from documents)
      select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
    "op8_url_filter": r"""with h as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
      rules as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) as r(decision, rule_host, rule_path)),
      best as (select page_id, rule_host || rule_path as rule, decision from h join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        qualify row_number() over (partition by page_id order by length(rule_host || rule_path) desc) = 1)
      select h.page_id, host, path, rule, coalesce(decision, 'allow') as verdict from h left join best on h.page_id = best.page_id""",
}

ORACLES["op13_collocations"] = rf"""with words as (select lang, piece, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w
        from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({FOLDED}, '[.,;:!?\n\x0B\x0C\r]')) as piece from documents)),
      sizes as (select unnest([1, 2, 3, 4, 5]) as k),
      grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, sizes where len(w) >= k),
      f as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 100),
      totals as (select lang, sum(len(w))::bigint as n from words group by lang),
      cuts as (select lang, k, phrase, a, unnest(range(1, k)) as c, string_split(phrase, ' ') as w from f where k > 1),
      scored as (select c.lang, c.phrase, c.k, c.a, l.a as l, r.a as r, n, ((1000::hugeint * c.a * n) // (l.a::hugeint * r.a))::bigint as score
        from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:c], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(w[c + 1:], ' ') join totals t on t.lang = c.lang
        qualify row_number() over (partition by c.lang, c.phrase order by score, c.c) = 1),
      subs as (select lang, a, k, unnest(range(2, k)) as s, string_split(phrase, ' ') as w from f where k > 2),
      covered as (select lang, phrase, max(a) as longer from (select lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) as phrase from subs) group by all),
      kept as (select s.* from scored s left join covered v on v.lang = s.lang and v.phrase = s.phrase where v.longer is null or v.longer < s.a)
      select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept
      qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The registered ``opN_*`` queries: thin views of the operators over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, html, packing, pii, quality, secrets, simhash, sortmeans, spelling, tokenfiles, toxicity
from .common import held_out, read, scratch


def tokenizer_file() -> str:
    """The byte-level tokenizer that the queries use; a file of the installation, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", held_out())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(read(spark, sf_dir, "documents"), model, ["doc_id"], path_col="source")
    return found.withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", held_out())


def op4_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), tokenizer_file())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'tokens')}/ids"
    tokenfiles.write(read(spark, sf_dir, "documents"), path, tokenizer_file())
    return tokenfiles.checksums(spark, path)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents")))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_quality, op4_multiprobe_ann, op5_simhash, op6_bpe_automaton, op7_pii, op8_best_fit_packing, op9_fingerprints, op10_html_extraction, op11_token_files, op12_spelling, op13_sort_means)}


def _sort_means_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """The clustering in SQL: every vector against every centroid, round by round."""
    far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT"
    floor = "((s - ((s % n) + n) % n) // n)"
    steps = [
        f"x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := {far}, c := c.c)) AS b FROM x v, c{i} c GROUP BY v.r)")
        if i < rounds:
            parts = f"SELECT b.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT x.v, a{i}.b, unnest(range(1, {dims + 1})) AS i FROM x JOIN a{i} USING (r)) GROUP BY 1, 2"
            steps.append(f"m{i} AS (SELECT c, list({floor} ORDER BY i) AS v FROM ({parts}) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256"
    return f"WITH {', '.join(steps)} {last} FROM x JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.c = b.c"


def oracle_sql() -> dict[str, str]:
    return {"op13_sort_means": _sort_means_sql()}

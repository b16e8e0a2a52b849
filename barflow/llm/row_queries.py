"""op3, op6, op8 and op10: thin queries over the given tables."""

from __future__ import annotations

import public_tokenizers

from barflow.llm import chat, mixing, packing, url_filter
from barflow.llm.common import load, query

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.judge(load(spark, sf_dir, "pages", "page_id", "url"), rules)


OP3_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rule, h, p, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
SELECT page_id, host, path,
  (SELECT r.rule FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.rule) DESC LIMIT 1), 'allow') AS verdict
FROM hp
"""


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.sequences(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_chat_formatting(spark, sf_dir):
    planted = spark.createDataFrame([(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(planted)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.summaries(chat.format_turns(turns, tokenizer), tokenizer)


OP8_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


@query
def op10_source_mixing(spark, sf_dir):
    out = mixing.mix(load(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {
    "op3_url_filter": op3_url_filter,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op10_source_mixing": op10_source_mixing,
}
ORACLES = {"op3_url_filter": OP3_SQL}

"""Registered queries of this subpackage, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm import (
    bpe, fill_middle, html_templates, inner_product, line_crf, line_templates, mixing, outputs, quality_rules, records,
    secret_scan, simhash, spelling, warc,
)
from temblor.session import share_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of documents labelled good."""
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, trusted_ids(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "score")


@query
def op10_bpe(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Encode every document and decode it again."""
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer or tokenizer_path("byte_bpe_50k.json"))


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.fingerprint_groups(table(spark, folder, "documents"), "doc_id", "text", words=3, radius=2)


@query
def op2_token_records(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents as token records and read the files back."""
    out = outputs.new_folder(spark, "records")
    records.write_records(table(spark, folder, "documents"), out, tokenizer or tokenizer_path("word_bpe_49k.json"))
    return records.read_records(spark, out).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as WARC archives and read them back."""
    out = outputs.new_folder(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), out)
    return warc.read_warc(spark, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
k as (select *, max(page_id) over (partition by body) as keeper, strlen(body)::bigint as payload_bytes,
             list_transform(string_split(sha1(body), ''), lambda x: strpos('0123456789abcdef', x) - 1) as hex from p)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((hex[(5*i)//4 + 1]*16 + coalesce(hex[(5*i)//4 + 2], 0)) >> (3 - (5*i)%4)) & 31)::int + 1, 1)),
         'string_agg', '') as payload_digest,
       case when page_id = keeper then 'response' else 'revisit' end as record_type,
       case when page_id <> keeper then keeper end as refers_to from k"""


@query
def op5_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    docs = table(spark, folder, "documents")
    return line_templates.drop_recurring_lines(docs).select("doc_id", "text", "n_chars")


#: Target weights of the languages; domains and sources go by their size.
LANGUAGES = {"en": 14, "de": 3, "fr": 3, "es": 2}


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents name no domain: sources with an even number stand for one, the others for another."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn("domain", F.when(F.substring(number, -1, 1).isin("0", "2", "4", "6", "8"), "even")
                           .otherwise("odd"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the target weights, half of all tokens."""
    docs = with_domain(table(spark, folder, "documents"))
    mixed = mixing.mix(docs, ["domain", "lang", "source"], F.floor(F.col("all") / 2), {"lang": LANGUAGES}, 4, 1)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch")


@query
def op8_inner_product(spark: SparkSession, folder: str) -> DataFrame:
    """Five best inner products of each query among all other vectors."""
    vectors = inner_product.whole_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return inner_product.top_k(vectors, vectors.where("id % 50 = 0"), 5)


ORACLES["op8_inner_product"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256*x::double)::bigint) as e from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1]*z[2]))::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


@query
def op7_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; a fifth of the labels is held out."""
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    labels = table(spark, folder, "labels").where(part != 0)
    scored = line_crf.quality(table(spark, folder, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", (part == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_html_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_templates.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def _share_sql(nodes: str, parents: str, name: str) -> str:
    """Siblings' shares of their parent's budget, as tables of the name."""
    near = "(case when weight > 0 then \"limit\"::double/weight::double end) nulls last, key nulls first"
    return f"""
{name}_1 as (select *, coalesce(sum("limit") over (partition by {parents} order by {near}
               rows between unbounded preceding and 1 preceding), 0) as used,
             sum(weight) over (partition by {parents} order by {near}
               rows between current row and unbounded following) as rest from {nodes}),
{name}_2 as (select *, weight > 0 and "limit"::hugeint*rest <= (budget - used)*weight as filled from {name}_1),
{name}_3 as (select *, budget - coalesce(sum("limit") filter (where filled) over (partition by {parents}), 0) as remaining,
             coalesce(sum(weight) filter (where not filled) over (partition by {parents}), 0) as open_weight
             from {name}_2),
{name} as (select * exclude (budget), (case when filled then "limit"
             when weight > 0 then greatest(remaining*weight // open_weight, 0)
             when open_weight = 0 then greatest(0, least("limit", budget - used)) else 0 end)::bigint as given
           from {name}_3)"""


_NODES = "select {names}, {key} as key, sum(t)::bigint as tokens, sum(4*t)::bigint as \"limit\", any_value(b)::bigint as budget"
ORACLES["op6_mixing"] = """
with d as (
  select doc_id, lang, source, case when right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 1)
    in ('0', '2', '4', '6', '8') then 'even' else 'odd' end as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n from documents),
l as (select domain, lang, source, sum(n) as t from d group by all),
n1 as (select *, tokens as weight from (""" + _NODES.format(names="domain", key="domain") + """
  from l, (select least(floor(sum(t)/2), 4*sum(t)) as b from l) group by domain)),""" + _share_sql("n1", "1", "s1") + """,
n2 as (select *, """ + "case lang " + " ".join(f"when '{k}' then {v}" for k, v in LANGUAGES.items()) + """ else 1 end as weight
  from (""" + _NODES.format(names="domain, lang", key="lang") + """
  from l join (select domain, given as b from s1) using (domain) group by domain, lang)),""" + _share_sql(
    "n2", "domain", "s2") + """,
n3 as (select *, tokens as weight from (""" + _NODES.format(names="domain, lang, source", key="source") + """
  from l join (select domain, lang as g, given as b from s2) x using (domain)
  where l.lang is not distinct from x.g group by domain, lang, source)),""" + _share_sql("n3", "domain, lang", "s3") + """,
p as (select domain, lang, source, given, tokens, case when tokens > 0 then given // tokens else 1 end as whole from s3),
o as (select d.*, p.whole, given - whole*tokens as room, md5(concat(coalesce(doc_id::varchar, 'null'), ':1:', whole)) as h
      from d join p on d.domain = p.domain and d.lang is not distinct from p.lang
                   and d.source is not distinct from p.source),
r as (select *, sum(n) over (partition by domain, lang, source order by h) as upto from o)
select doc_id, domain, lang, source, unnest(range(whole))::int as epoch from r
union all
select doc_id, domain, lang, source, whole::int from r where whole < 4 and upto <= room"""


def _listed(spans, kinds: list[str]):
    """Spans of the kinds as ``kind:start:end``, joined by commas."""
    of_kind = F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(of_kind, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by kind and place."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = [r.kind for r in secret_scan.BASE]
    return found.select("doc_id", *map(count, base), F.sha2(_listed("secrets", base), 256).alias("base_sha256"),
                        _listed("secrets", base + [r.kind for r in secret_scan.MORE]).alias("spans"))


def _secrets_sql() -> str:
    """Spans by the texts between the matches of each rule."""
    parts = []
    for k, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        head = f"(?i:{rule.head})" if rule.any_case else f"(?:{rule.head})"
        pattern = f"{head}({rule.run})".replace("'", "''")
        group = 2 if "(" in rule.head else 1
        parts.append(f"""select doc_id, {k} as k, '{rule.kind}' as kind, {rule.least} as least,
            string_split_regex(t, '{pattern}') as rest, regexp_extract_all(t, '{pattern}') as hits,
            regexp_extract_all(t, '{pattern}', {group}) as runs from d where regexp_matches(t, '{pattern}')""")
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
x as (select doc_id, k, kind, least, unnest(range(1, len(hits) + 1)) as j, rest, hits, runs from m),
p as (select doc_id, k, kind, length(hits[j]) as n, length(runs[j]) as run, least,
  list_sum(list_transform(rest[1:j], lambda y: length(y)))::bigint
  + coalesce(list_sum(list_transform(hits[1:j - 1], lambda y: length(y))), 0)::bigint as start from x),
s as (select doc_id, k, kind, start, kind || ':' || start || ':' || (start + n) as said from p where run >= least),
g as (select doc_id, {counts}, string_agg(said, ',' order by start, k) filter (kind in ({base})) as base,
  string_agg(said, ',' order by start, k) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


ORACLES["op11_secret_scan"] = _secrets_sql()


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with the word it is a variant of."""
    return spelling.spelling_forms(table(spark, folder, "documents"))


ORACLES["op12_spelling"] = """
with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc),
r as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all),
b as (select run, n, hex(encode(doc_id || ':' || run)) as said from r where length(run) >= 6),
h as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(said) // 2),
  lambda i: ('0x' || said[2 * i + 1:2 * i + 2])::bigint)),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) as h from b, t),
w as (select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word,
  sum(n)::bigint as n from h group by 1 having sum(n) >= 5 and length(word) >= 6),
d as (select word, n, i, left(word, i) || substr(word, i + 2) as less
  from (select *, unnest(range(length(word))) as i from w)),
p as (select a.word, b.word as other, b.n as m from d a join d b using (i, less) where a.word <> b.word
  union select d.word, w.word, w.n from d join w on d.less = w.word
  union select w.word, d.word, d.n from d join w on d.less = w.word),
g as (select word, count(*) as n_near, (min({'m': -m, 'word': other})).word as best, max(m) as best_n from p group by word),
f as (select word, n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * n then best end as form,
  case when best_n >= 5 * n then best_n end as form_n from w left join g using (word)),
c as (select word, coalesce(form, word) as root from f
  union all select c.word, f.form from c join f on c.root = f.word
  where f.form is not null and c.root <> f.form and c.word <> c.root),
x as (select c.word, c.root from c join f on c.root = f.word where f.form is null)
select word, form, root, n, n_near, form_n from f join x using (word)"""


@query
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut and put in another order, and restored from that."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    formed = fill_middle.fill_in_middle(docs)
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_middle"] = """
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
  ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
  ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, t, w, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a,
  greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
       when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n::bigint as n, form, array_to_string(w[1:a], '') as x, array_to_string(w[a + 1:b], '') as y,
  array_to_string(w[b + 1:n], '') as z from c)
select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars,
  case when form <> 'plain' then length(y) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y
    else '<P>' || x || '<S>' || z || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p"""

"""Queries over the driver's tables for the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, html_cut, lattice_lm, licenses, merkle, mixing, packing, quality, runs, secrets, simhash, simple8b, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.deduplicate(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op5_warc_revisits"] = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
b as (select page_id, strlen(html) as payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest
    from p),
g as (select payload_digest, min(page_id) as original from b group by 1)
select page_id, payload_bytes, payload_digest, case when page_id is not distinct from original then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from original then null else original end as refers_to
from b join g using (payload_digest)
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def quality_sql(source: str = "documents") -> str:
    """The rules over ``source``, as common table expressions that end in ``verdict``."""
    cut = "((value >> greatest(length(ltrim(bin(value), '0')) - 6, 0)) << greatest(length(ltrim(bin(value), '0')) - 6, 0))"
    levels = ""
    for depth, keys in enumerate(("lang, source, ", "lang, ", "")):
        levels += f""",
s{depth} as (select {keys}measure, v, sum(n) as n from sketch group by {keys}measure, v),
c{depth} as (select *, sum(n) over (partition by {keys}measure order by v) as upto, sum(n) over (partition by {keys}measure) as docs from s{depth}),
q{depth} as (select {keys}measure, max(docs) as docs, min(case when upto * 100 >= docs * 25 then v end) as a,
    min(case when upto * 100 >= docs * 50 then v end) as b, min(case when upto * 100 >= docs * 75 then v end) as c from c{depth} group by {keys}measure)"""
    pick = ", ".join(f"case when q0.docs >= {quality.MIN_DOCS} then q0.{x} when q1.docs >= {quality.MIN_DOCS} then q1.{x} else q2.{x} end as {x}" for x in "abc")
    tests, limits = [], []
    value = lambda k, x: f"max(case when measure = '{k}' then {x} end)"
    for k, (up, down, rate, size, event) in quality.MEASURES.items():
        a, b, c = (value(k, x) for x in "abc")
        width = f"1::bigint << greatest(length(ltrim(bin({b}), '0')) - 6, 0)"
        reach = f"{quality.SPREAD} * (greatest({b} - {a}, {c} - {b}) + greatest(ceil({rate * event} / greatest({value(size, 'b')}, 1)), {width}))"
        if up:
            limits.append(f"{b} + {reach} as high_{k}")
            tests.append(f"{k} <= high_{k}")
        if down:
            limits.append(f"{b} - {reach} as low_{k}")
            tests.append(f"{k} >= low_{k}")
    values = " union all ".join(f"select lang, source, '{k}' as measure, {k} as value from facts" for k in (*quality.MEASURES, *quality.SIZES))
    return rf"""
d as (select row_number() over () as r, * from {source}),
t as (select *, coalesce(text, '') as body from d),
w as (select *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select r, i, list_slice(words, i, i + 7) as g from (select r, words, unnest(range(1, len(words) - 6)) as i from w)),
rep as (select r, g from win group by r, g having count(*) > 1),
pos as (select distinct r, unnest(range(i, i + 8)) as p from win join rep using (r, g)),
cov as (select r, count(*) as n_repeat_words from pos group by r),
facts as (select w.*, len(words) as n_words, len(lines) as n_lines, length(array_to_string(words, '')) as word_chars,
      length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols,
      len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
      n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words as base_failed,
      1000 * n_symbols // greatest(word_chars, 1) as symbols, 1000 * n_dup_lines // greatest(len(lines), 1) as dup_lines,
      1000 * coalesce(n_repeat_words, 0) // greatest(n_words, 1) as repeats,
      1000 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) // greatest(n_words, 1) as stutter,
      1000 * length(regexp_replace(body, '\P{{Lu}}+', '', 'g')) // greatest(word_chars, 1) as upper,
      100 * word_chars // greatest(n_words, 1) as word_length from w left join cov using (r)),
sketch as (select lang, source, measure, {cut} as v, count(*) as n from ({values}) group by all){levels},
picked as (select q0.lang, q0.source, q0.measure, {pick} from q0 join q1 on q0.lang is not distinct from q1.lang and q0.measure = q1.measure
    join q2 on q0.measure = q2.measure),
limits as (select lang, source, {", ".join(limits)} from picked group by lang, source),
verdict as (select facts.*, not base_failed and {" and ".join(tests)} as kept from facts
    join limits on facts.lang is not distinct from limits.lang and facts.source is not distinct from limits.source)"""


SQL["op10_quality_rules"] = f"with {quality_sql()} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, {', '.join(quality.MEASURES)} from verdict"


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(table(spark, sf_dir, "documents"))


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


# The table has no paths, so files get some: a folder for each source, language and hundred ids; every tenth file is a licence file,
# every other of these one folder up.
FOLDER = "concat(source, '/', lang)"
BLOCK = "concat(source, '/', lang, '/', cast({div} as string))"


def file_path(div: str, text: str) -> str:
    block = BLOCK.format(div=div)
    return f"case when doc_id % 20 = 3 then concat({FOLDER}, '/LICENSE.', {text}) when doc_id % 20 = 13 then concat({block}, '/LICENSE.', {text}) else concat({block}, '/', {text}, '.txt') end"


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(file_path("doc_id div 100", "cast(doc_id as string)")).alias("path"), "text")
    return licenses.scan(files)


def license_sql() -> str:
    values = ", ".join(f"('{k}', '{t}')" for k, t in licenses.TEMPLATES)
    n = len(licenses.TEMPLATES)
    cue = licenses.CUE.removeprefix("(?i)")
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
with tp as (select * from (values {values}) t(licence, text)),
tt as (select licence, term, count(*) as tf from (select licence, unnest({words('text')}) as term from tp) group by all),
td as (select term, ln({n + 1}.0 / (count(*) + 1)) + 1 as idf from tt group by term),
tw as (select licence, term, tf * idf as x, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) over (partition by licence)) as w from tt join td using (term)),
f as (select doc_id, {file_path("doc_id // 100", "cast(doc_id as varchar)")} as path, text from documents),
ln as (select doc_id, i, parts[i] as line from (select doc_id, string_split(text, chr(10)) as parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from f) where regexp_matches(parts[i], '{cue}', 'i')),
lt as (select doc_id, i, term, count(*) as tf from (select doc_id, i, unnest({words('line')}) as term from ln) group by all),
lx as (select doc_id, i, term, tf * coalesce(idf, ln({n + 1}.0) + 1) as x from lt left join td using (term)),
nm as (select doc_id, i, sqrt(sum(x * x)) as norm from lx group by all),
sc as (select doc_id, licence, round(sum(lx.x * w) / max(norm), 6) as score from lx join tw using (term) join nm using (doc_id, i) group by doc_id, i, licence),
own as (select doc_id, licence, score from sc where score >= {licenses.THRESHOLD} qualify row_number() over (partition by doc_id order by score desc, licence) = 1),
r as (select f.doc_id, path, licence, score, regexp_replace(path, '/[^/]*$', '') as folder, regexp_matches(path, '/(licen[cs]e|copying)[^/]*$', 'i') as grants from f left join own using (doc_id)),
g as (select folder as above, licence, score, path from r where grants and licence is not null qualify row_number() over (partition by folder order by score desc, path) = 1),
n as (select r.doc_id, g.* from r join g on r.folder = g.above or starts_with(r.folder, g.above || '/') qualify row_number() over (partition by r.doc_id order by length(g.above) desc) = 1)
select r.doc_id, r.path, coalesce(r.licence, n.licence) as licence, coalesce(r.score, n.score) as score,
  case when r.licence is not null then 'own' when n.licence is not null then 'inherited' end as via, case when r.licence is not null then r.path else n.path end as licensed_by
from r left join n using (doc_id)"""


SQL["op6_license_scan"] = license_sql()

# A domain for each source, by the number in its name, and relative weights; what has none weighs 1.
DOMAIN = "case when source in ('src0', 'src1', 'src2', 'src3', 'src4') then 'web' when source in ('src5', 'src6', 'src7', 'src8', 'src9') then 'books' when source in ('src10', 'src11', 'src12', 'src13', 'src14') then 'forums' else 'news' end"
WEIGHTS = {"domain": {"web": 3, "books": 3, "forums": 1, "news": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 1, "src1": 3}}
PERCENT, EPOCHS, SEED = 90, 3, 42


@query
def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN), WEIGHTS, PERCENT, EPOCHS, SEED)


def mixture_sql(source: str, percent: int, epochs: int) -> str:
    """The mixture over ``source`` (doc_id, text, lang, source ...), as common table expressions that end in ``mixed``."""
    out = rf"""
mr as (select *, {DOMAIN} as domain, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n_tokens from {source}),
m0 as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * {epochs} as room, (sum(sum(n_tokens)) over () * {percent} // 100)::bigint as budget from mr where n_tokens > 0 group by all)"""
    for depth, name in enumerate(mixing.TREE):
        keys, parent = mixing.TREE[: depth + 1], mixing.TREE[:depth]
        k, over = ", ".join(keys), "partition by " + ", ".join(parent) if parent else ""
        weight = "case " + " ".join(f"when {name} = '{n}' then {w}" for n, w in WEIGHTS[name].items()) + " else 1 end"
        match = " and ".join(f"m.{c} is not distinct from s.{c}" for c in keys)
        out += f""",
n{depth} as (select {k}, sum(room)::bigint as room, max(budget) as budget, {weight} as weight from m{depth} group by {k}),
o{depth} as (select *, room * sum(weight) over (w rows between current row and unbounded following)
    <= (budget - coalesce(sum(room) over (w rows between unbounded preceding and 1 preceding), 0)) * weight as is_full from n{depth} window w as ({over} order by room / weight, {name} nulls first)),
s{depth}x as (select {k}, case when is_full then room else (budget - coalesce(sum(case when is_full then room end) over ({over}), 0)) * weight // sum(case when not is_full then weight end) over ({over}) end as given from o{depth}),
m{depth + 1} as (select m.* replace (s.given::bigint as budget) from m{depth} m join s{depth}x s on {match})"""
    match = " and ".join(f"r.{c} is not distinct from m.{c}" for c in mixing.TREE)
    return out + f""",
mk as (select r.*, budget % tokens as rest, budget // tokens as whole, ('0x' || substr(md5(concat('{SEED}:', budget // tokens + 1, ':', coalesce(doc_id::varchar, ''))), 1, 15))::bigint as k
    from mr r join m3 m on {match} where n_tokens > 0),
mt as (select *, whole + (sum(n_tokens) over (partition by domain, lang, source order by k, doc_id) <= rest)::int as times from mk),
mixed as (select mt.* exclude (times, k, rest, whole), e::int as epoch from mt, unnest(range(1, times + 1)) t(e))"""


SQL["op7_source_mixture"] = f"with {mixture_sql('documents', PERCENT, EPOCHS)} select doc_id, domain, lang, source, n_tokens, epoch from mixed"


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.detect(runs.with_tails(table(spark, sf_dir, "documents"))))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
m as (select part, doc_id, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
      + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::int
      + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by 1),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad from m left join l using (doc_id) group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
p as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from p, unnest(range(1, 6)) t(step)),
r as (select part, filter_order, step, own,
      sum(case when mask & (own + before) = 0 then n else 0 end)::bigint as kept,
      sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
      sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
      sum(case when mask = own then n else 0 end)::bigint as unique_fails,
      sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
      sum(case when mask & own <> 0 and mask & before = 0 then bad else 0 end)::bigint as toxic_lost from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

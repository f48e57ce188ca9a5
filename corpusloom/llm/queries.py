"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe, classifier, conversation_repair, html_text, line_dedup, merkle, mixing, quality, secret_scan, simhash, substrings,
    token_files, winnow)


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id", "n_links")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.fingerprint_edits(_table(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.digest("fingerprint").alias("fingerprint"), winnow.digest("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("fingerprint").alias("n_grams"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return quality.judge(docs, labels).select("doc_id", *quality.BASE_COUNTS, "base_failed", "kept", "rule")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_table(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(_table(spark, sf_dir))


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.audit_documents(_table(spark, sf_dir), tampered, {"n_chars": F.col("n_chars") + 1})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_line_dedup, op4_winnowing, op5_quality_rules, op6_bpe,
                            op7_token_files, op8_substring_dedup, op9_html_text, op10_secret_scan,
                            op11_classifier, op12_conversation_repair, op13_merkle)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIXING_SQL = r"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as key
  from documents),
weighed as (
  select source, cast(sum(size) as bigint) as source_size,
    cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint) as weight
  from sized group by source),
-- Sources reach their limit in the order of limit / weight: the level is that of the first which does not.
leveled as (
  select source, 3 * source_size as most, weight,
    row_number() over (order by 3.0 * source_size / weight, source nulls last) as turn,
    sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3.0 * source_size / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over (order by 3.0 * source_size / weight, source nulls last
      rows between current row and unbounded following) as free
  from weighed),
level as (
  select coalesce(arg_min(cast(left_over as double) / cast(free as double), turn)
    filter (where most >= cast(left_over as double) / cast(free as double) * weight), 0) as level from leveled),
targets as (
  select source, source_size, least(cast(3 * source_size as double), level * weight) as target,
    case when source_size > 0 then cast(floor(least(cast(3 * source_size as double), level * weight) / source_size) as bigint) else 0 end as epochs
  from weighed, level),
ordered as (
  select sized.*, source_size, target, epochs, target - epochs * source_size as rest,
    sum(size) over (partition by sized.source order by key, size rows between unbounded preceding and current row) as upto
  from sized join targets on sized.source is not distinct from targets.source),
cuts as (select source, max(key) filter (where size > 0 and 2 * upto - size <= 2 * rest) as cut from ordered group by source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (epochs + case when key <= cut then 1 else 0 end) as bigint) as taken
from ordered join cuts on ordered.source is not distinct from cuts.source
"""

LINES_SQL = f"""
with lines as (
  select doc_id, n, unnest(lines) as line, generate_subscripts(lines, 1) as pos
  from (select doc_id, row_number() over () as n, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
keyed as (select *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (select keyed.*, owner is not null and owner <> doc_id as gone from keyed left join owners on keyed.key = owners.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id, n
"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ord(c) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda crc, byte: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, (
        "cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text"))) + ")"


MERKLE_SQL = f"""
with recursive
found as (
  select doc_id, lang, {_leaf('n_chars')} as leaf,
    case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf('(n_chars + 1)')} end as claimed
  from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from found),
nodes as (
  select lang, 0 as level, pos, n, leaf as digest from placed
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos))
  from nodes where n > 1 group by lang, level, pos // 2, n),
subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, pos, n, digest from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by level, pos // 2, n),
ups as (select placed.*, s.pos as tree_pos, s.digest as subroot from placed join subroots s on placed.lang is not distinct from s.lang),
steps as (
  select doc_id, leaf, ups.lang, ups.pos, 0 as part, level, (ups.pos >> level) & 1 as right_side, null as sibling
  from ups, (select distinct lang, level from nodes where n > 1) l where l.lang is not distinct from ups.lang
  union all
  select doc_id, leaf, ups.lang, ups.pos, 1, level, (ups.tree_pos >> level) & 1, null
  from ups, (select distinct level from tops where n > 1)),
siblings as (
  select s.lang, s.pos, s.part, s.level, s.right_side, coalesce(nodes.digest, tops.digest, '') as digest
  from steps s join ups on ups.lang is not distinct from s.lang and ups.pos = s.pos
  left join nodes on s.part = 0 and nodes.lang is not distinct from s.lang and nodes.level = s.level and nodes.pos = xor(s.pos >> s.level, 1)
  left join tops on s.part = 1 and tops.level = s.level and tops.pos = xor(ups.tree_pos >> s.level, 1)),
paths as (
  select lang, pos, string_agg(digest, '' order by part, level) as proof,
    list(right_side || digest order by part, level) as steps
  from siblings group by lang, pos),
folded as (
  select doc_id, leaf, subroot, (select digest from tops where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
    list_reduce(list_concat([coalesce(claimed, leaf)], coalesce(steps, [])), lambda h, s:
      sha256(case when s[1] = '1' then s[2:] || h else h || s[2:] end)) as folded_root
  from ups left join paths on paths.lang is not distinct from ups.lang and paths.pos = ups.pos)
select *, folded_root = root as verified from folded
"""


def _edit(weight: str, cost: str, letter: str) -> str:
    """A weight, six digits of cost and then the letters, with an edit more."""
    return f"lpad(cast(cast(left({weight}, 6) as int) + {cost} as varchar), 6, '0') || {weight}[7:] || '{letter}'"


def _inserted(rows: str) -> str:
    k0, k1, k2, k3 = (_edit(f"k{q}", "2", "I") for q in range(4))
    return (f"select * replace (least(k2, {k0}, {k1}, {k3}) as k2, least(k3, {k2}) as k3) from ({rows})")


def _kept(role: str, *froms: str) -> list[str]:
    """What leads to a state: the row kept, if it has the role, or reroled."""
    keep = [f"case when fault < 2 and initial = '{role}' then {_edit(k, 'fault', 'K')} end" for k in froms]
    return keep if role == "s" else keep + [f"case when fault < 2 then {_edit(k, '2 + fault', 'R')} end" for k in froms]


def _deleted(k: str) -> str:
    return _edit(k, "3", "D")


CONVERSATION_SQL = f"""
with recursive
fated as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as fate
  from conversations),
damaged as (
  select coalesce(cast(conv_id as varchar), '-') as key, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case fate when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from fated),
placed as (
  select *, row_number() over (partition by key order by turn nulls first, role, sha256(strlen(role) || ':' || role || text)) as pos
  from damaged),
seen as (
  select *, left(role, 1) as initial, trim(text, {_BLANKS}) as bare, min(pos) over (partition by key, role, text) as first_pos,
    lag(left(role, 1)) over (partition by key order by pos) as earlier
  from placed),
marked as (
  select *, case when bare = '' then 'blank' when first_pos < pos then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as name,
    case name when 'blank' then 2 when 'duplicate' then 2 when 'truncated' then 1 else 0 end as fault
  from seen),
sums as (
  select key, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where name = 'blank') as blank,
    count(*) filter (where name = 'duplicate') as duplicate, count(*) filter (where name = 'truncated') as truncated,
    count(*) filter (where pos > 1 and earlier || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from marked group by key),
-- The least weight from the start to each state: nothing yet, after s, after u, after a.
steps as (
  select key, n, 0 as i, '000000' as k0, cast(null as varchar) as k1, cast(null as varchar) as k2, cast(null as varchar) as k3 from sums
  union all
  select key, n, i + 1, {_deleted('k0')}, least({', '.join([_deleted('k1'), *_kept('s', 'k0')])}),
    least({', '.join([_deleted('k2'), *_kept('u', 'k0', 'k1', 'k3')])}), least({', '.join([_deleted('k3'), *_kept('a', 'k2')])})
  from ({_inserted(_inserted("select steps.*, initial, fault from steps join marked on steps.key = marked.key and pos = i + 1"))})),
solved as (
  select key, least(k0, k3) as weight from ({_inserted(_inserted("select * from steps where i = n"))})),
answers as (select key, cast(left(weight, 6) as bigint) as cost, weight[7:] as audit from solved),
letters as (
  select key, length(replace(audit, 'D', '')) % 2 as odd, unnest(string_split(audit, '')) as letter, generate_subscripts(string_split(audit, ''), 1) as place
  from answers where audit <> ''),
counted as (
  select *, count(*) filter (where letter <> 'I') over w as pos, count(*) filter (where letter <> 'D') over w - 1 as turns_before
  from letters window w as (partition by key order by place)),
repaired as (
  select c.key, string_agg(case letter when 'K' then role when 'I' then next || ':' else next end
    || case letter when 'I' then '' else ':' || text end, chr(10) order by place) as lines
  from (select *, case when turns_before > 0 and (turns_before - odd) % 2 = 1 then 'assistant' else 'user' end as next from counted where letter <> 'D') c
  left join placed on letter <> 'I' and placed.key = c.key and placed.pos = c.pos group by c.key)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv_id, coalesce(cast(conv_id as varchar), '-') as key from conversations) every
left join sums on sums.key = every.key left join answers on answers.key = every.key left join repaired on repaired.key = every.key
"""

ORACLES = {"op2_mixing": MIXING_SQL, "op3_line_dedup": LINES_SQL,
           "op12_conversation_repair": CONVERSATION_SQL, "op13_merkle": MERKLE_SQL}

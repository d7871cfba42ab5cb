"""The operators over the document tables, and SQL that states their results where it can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import (
    chat, classlm, codes, contamination, exact, language, lines, manifest, mixing, quality, secrets, simhash, tokens,
)
from fleetloom.llm.common import in_fold, learnable, read, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


@query("op1_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    dictionaries = language.fit_dictionaries(docs.where(learnable("doc_id", 4, 2)))
    found = docs.select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), language.identify_language(F.col("text"), dictionaries).alias("found")
    )
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


@query(
    "op2_exact_dedup",
    r"""
    with d as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t
        from documents
    )
    select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = min(doc_id) over (partition by t) as kept, text_sha256
    from d
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(read(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


@query(
    "op3_secrets",
    r"""
    with d as (
        select row_number() over () as row, doc_id, coalesce(text, '') as t from documents
    ), patterns(kind, p) as (
        values ('assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
               ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+'), ('candidate', '[A-Za-z0-9+/_=-]{20,}')
    ), found as (
        select row, doc_id, kind, p, regexp_extract_all(t, p) as found, string_split_regex(t, p) as gaps from d, patterns
    ), pieces as (
        select row, doc_id, kind, p, unnest(found) as m, unnest(gaps[:len(found)]) as gap, generate_subscripts(found, 1) as i
        from found where len(found) > 0
    ), spans as (
        select row, kind, p, m, cast(sum(length(gap) + length(m)) over (partition by row, kind order by i) as bigint) as stop from pieces
    ), base as (
        select row, kind, case kind when 'assign' then 0 when 'access' then 1 else 2 end as rank, stop - length(m) as start, stop
        from spans
        where kind = 'assign' and length(regexp_extract(m, p, 2)) >= 8 or kind = 'access' and length(m) >= 16
           or kind = 'hex' and length(m) >= 32
    ), candidates as (
        select row, stop - length(m) as start, stop, m,
               case when regexp_matches(m, '^[0-9a-fA-F]+$') then 3 when regexp_matches(m, '^[0-9A-Za-z]+$') then 4 else 5 end as rank
        from spans s
        where kind = 'candidate'
          and not exists (select 1 from base b where b.row = s.row and b.start < s.stop and s.stop - length(s.m) < b.stop)
          and not regexp_matches(m, '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$')
          and not regexp_matches(m, '^[0-9+/_=-]+$') and not regexp_matches(m, '^[A-Za-z+/_=-]+$')
          and not regexp_matches(m, '(?i)(example|sample|placeholder|dummy|xxxxx|00000|12345678)')
    ), windows as (
        select row, start, rank, m, unnest(range(1, length(m) - 18)) as i from candidates
    ), hot as (
        select row, start as of_start, rank, start + i - 1 as start, start + i + 19 as stop from windows
        where list_aggregate(string_split(substr(m, i, 20), ''), 'entropy') >= case rank when 3 then 2.95 when 4 then 3.65 else 3.85 end
    ), islands as (
        select *, sum(new) over (partition by row, of_start order by start) as island
        from (select *, case when start <= lag(stop) over (partition by row, of_start order by start) then 0 else 1 end as new from hot)
    ), high as (
        select row, case rank when 3 then 'high_hex' when 4 then 'high_alnum' else 'high_base64' end as kind, rank,
               min(start) as start, max(stop) as stop
        from islands group by row, of_start, rank, island
    ), every as (
        select row, kind, rank, start, stop, true as in_base from base union all select row, kind, rank, start, stop, false from high
    ), listed as (
        select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
               count(*) filter (kind = 'hex') as n_hex,
               string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (in_base) as base,
               string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
        from every group by row
    )
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join listed using (row)
    """,
)
def find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_report(read(spark, folder, "documents"))


@query("op4_quality")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    may_learn = learnable("doc_id", 3, 1)
    model = quality.fit_quality(docs.where(may_learn), labels.where(may_learn))
    scored = docs.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), quality.quality_score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query(
    "op5_decontaminate",
    r"""
    with item_words as (
        select coalesce(cast(item_id as varchar), '') as item,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark
    ), windows as (
        select item, least(len(w), 13) as size, array_to_string(w[i:i + 12], ' ') as words
        from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item_words where len(w) > 0)
    ), d as (
        select row_number() over () as row, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents
    ), doc_windows as (
        select row, i, size, array_to_string(w[i:i + size - 1], ' ') as words
        from (select row, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from windows))
    ), found as (
        select distinct row, i, size, item from doc_windows join windows using (size, words)
    ), hits as (
        select row, count(distinct place) as n_hit from (select row, unnest(range(i, i + size)) as place from found) group by row
    ), named as (
        select row, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by row
    )
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
    from d left join hits using (row) left join named using (row)
    """,
)
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op6_mix_sources",
    r"""
    with sized as (
        select doc_id, coalesce('s' || source, '~') as source,
               cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
        from documents
    ), parted as (
        select *, lpad(cast(length(bin(size)) as varchar), 2, '0') || substr(bin(size), 1, 3) || '-'
                  || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 2) as part
        from sized
    ), numbered as (
        select *, row_number() over (partition by source order by part, size, doc_id) as number from parted
    ), s as (
        select source, cast(sum(size) as hugeint) as s from sized group by 1
    ), w as (
        select *, cast([5, 2, 1][1 + (row_number() over (order by source) - 1) % 3] as hugeint) as w from s
    ), less as (
        select *, sum(s) over () as all_s, sum(w) over () as all_w,
               coalesce(sum(s) over (order by s::double / w::double, source rows between unbounded preceding and 1 preceding), 0) as less_s,
               coalesce(sum(w) over (order by s::double / w::double, source rows between unbounded preceding and 1 preceding), 0) as less_w
        from w
    ), stopped as (
        select *, w * (3 * all_s - 4 * less_s) >= 4 * s * (all_w - less_w) as stops from less
    ), solved as (
        select *, coalesce(sum(s) filter (stops) over (), 0) as full_s, coalesce(sum(w) filter (stops) over (), 0) as full_w from stopped
    ), rated as (
        select source, cast(s as bigint) as source_size,
               case when stops then cast(2 * s as double)
                    else cast(w * (3 * all_s - 4 * full_s) as double) / cast(2 * (all_w - full_w) as double) end as target,
               cast(case when s = 0 then 0 when stops then 2 else w * (3 * all_s - 4 * full_s) end as hugeint) as up,
               cast(case when stops then 1 else 2 * s * (all_w - full_w) end as hugeint) as down
        from solved
    ), placed as (
        select *, (cast(('0x' || substr(sha256('mix' || source), 1, 8)) as hugeint) * down) // 4294967296 as start from rated
    )
    select doc_id, size, source_size, target,
           cast(((number * up + start) // down - ((number - 1) * up + start) // down) as bigint) * size as taken,
           cast(((number * up + start) // down - ((number - 1) * up + start) // down) as bigint) as copies
    from numbered join placed using (source)
    """,
)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mix(docs, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op7_class_lm")
def class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model, counts = classlm.fit(docs.where(learnable("doc_id", 10, 0)))
    scored = classlm.score(docs, model, counts)
    return scored.select(
        "doc_id",
        in_fold("doc_id", 10, 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(read(spark, folder, "documents"))


@query("op9_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    path = public_tokenizers.path(TOKENIZER)
    counted = docs.select(
        "doc_id",
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        tokens.token_count(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op10_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.written(F.col("mark")).alias("fingerprint"), "component_id")


@query(
    "op11_vector_codes",
    """
    with numbered as (
        select row_number() over () as row, vec_id, label, embedding as e from embeddings
    ), able as (
        select * from numbered
        where e is not null and len(e) > 0 and len(e) % 16 = 0
          and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    ), kept as (
        select row, vec_id, label,
               list_transform(e, lambda x: cast(least(greatest(floor(256 * cast(x as double)), -134217728), 134217728) as bigint)) as v, e
        from able where len(e) = (select len(e) from able where vec_id is not null order by vec_id, e limit 1)
    ), parts as (
        select row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as s from (select row, v, unnest(range(16)) as p from kept)
    ), firsts as (
        select v, row_number() over (order by vec_id) - 1 as k
        from (select vec_id, arg_min(v, e) as v from kept where vec_id is not null group by vec_id order by vec_id limit 64)
    ), book0 as (
        select p, k, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as c from (select v, k, unnest(range(16)) as p from firsts)
    )""" + "".join(
        f"""
    , near{i} as (
        select row, p, min(d * 64 + k) as best from (
            select row, p, k, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from parts join book{i} using (p)) group by row, p
    )"""
        + (
            f"""
    , moved{i} as (
        select p, k, list(m order by spot) as c from (
            select p, k, spot, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m
            from (select p, best % 64 as k, unnest(s) as x, generate_subscripts(s, 1) as spot from parts join near{i} using (row, p))
            group by p, k, spot) group by p, k
    ), book{i + 1} as (
        select p, k, coalesce(m.c, b.c) as c from book{i} b left join moved{i} m using (p, k)
    )"""
            if i < 2
            else ""
        )
        for i in range(3)
    )
    + """
    , coded as (
        select row, string_agg(printf('%02x', best % 64), '' order by p) as code, cast(sum(best // 64) as bigint) as error
        from near2 group by row
    )
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
           (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from book2) as codebooks_sha256
    from coded join kept using (row)
    """,
)
def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.vector_codes(read(spark, folder, "embeddings"))


def _tree_sql(levels: int = 12, group_levels: int = 4) -> str:
    """The tree level by level, for groups of up to 3 ** levels rows."""
    crc = """list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, o: case when o >= 0 then xor(c, o) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295)"""
    shown = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256({' || '.join([*map(shown, ('doc_id', 'source', 'lang', 'n_chars')), text])})"
    # crc32 ends with all bits turned over, so that it is even where this is odd.
    tampered = f"""case when coalesce(({crc}) & 1, 0) = 1 then replace(text, chr(10), '') else text end"""
    parts = [
        f"""with leaves as (
        select *, coalesce('s' || source, '') as g, {leaf(shown("text"))} as h, {leaf(shown(tampered))} as other from documents
    ), a0 as (
        select g, row_number() over (partition by g order by doc_id nulls first, h, other) - 1 as i, h, doc_id, other from leaves
    ), f0 as (
        select g, i, doc_id, h as leaf, h as own, other as folded, '' as proof from a0
    )"""
    ]

    def level(j: int, tree: str, nodes: str) -> str:
        held = f"list_filter(hs, lambda h, n: n - 1 <> slot)"
        return f"""
    , {tree}r{j} as (
        select g, i // 3 as i, list(h order by i) as hs, any_value(n) as n
        from (select g, i, h, count(*) over (partition by g) as n from {nodes}) group by g, i // 3
    ), {tree}{j + 1} as (
        select g, i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {tree}r{j}
    ), {{step}} as (
        select g, i, doc_id, leaf, own,
               case when n > 1 then sha256(array_to_string(list_transform(hs, lambda h, n: case when n - 1 = slot then folded else h end), ''))
                    else folded end as folded,
               case when n > 1 then proof || array_to_string({held}, '') else proof end as proof
        from (select f.* exclude (i, g), r.g, r.i, r.hs, r.n, f.i % 3 as slot from {{before}} f join {tree}r{j} r on f.g = r.g and f.i // 3 = r.i)
    )"""

    for j in range(levels):
        parts.append(level(j, "a", f"a{j}").format(step=f"f{j + 1}", before=f"f{j}"))
    parts.append(f"""
    , b0 as (
        select '' as g, row_number() over (order by g) - 1 as i, h, g as name from a{levels}
    ), e0 as (
        select '' as g, b.i, f.doc_id, f.leaf, b.h as own, f.folded, f.proof from f{levels} f join b0 b on f.g = b.name
    )""")
    for j in range(group_levels):
        parts.append(level(j, "b", f"b{j}").format(step=f"e{j + 1}", before=f"e{j}"))
    parts.append(f"""
    select doc_id, leaf, own as subroot, b.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = b.h as verified
    from e{group_levels} join b{group_levels} b using (g)""")
    return "".join(parts)


@query("op12_merkle_manifest", _tree_sql())
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    without = F.translate("text", "\n", "")
    return manifest.merkle_manifest(docs, tampered={"text": without}, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


# A user and an assistant who say what the template itself is made of.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op13_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    found = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    every = found.unionByName(spark.createDataFrame(CONTROL_TURNS, found.schema))
    windows = chat.format_conversations(every, public_tokenizers.path(TOKENIZER))
    return chat.conversation_digests(windows)

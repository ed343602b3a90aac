"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import ann, collocations, conversations, html, language, licenses, mixing, pieces, quality, secrets, shards, simhash, tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(table)``; a query may be called on a table of another folder too."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op3_shards", "documents")
def op3(documents: DataFrame) -> DataFrame:
    """Byte law; SQL lacks crc32, so tests hold it against a brute-force version."""
    return shards.byte_shards(documents, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bytes_before"
    )


@query(
    "op4_mixing",
    "documents",
    f"""
    with d as (select doc_id, source, len({WORDS})::bigint as size, md5('11:' || doc_id) as draw from documents),
    s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
    w as (select *, 1 + place % 3 as weight, 3 * source_size as cap from s),
    f as (
      select *, (sum(source_size) over ())::bigint as total, (sum(weight) over ())::bigint as weights,
        coalesce(sum(cap) over o, 0)::bigint as cap_before, coalesce(sum(weight) over o, 0)::bigint as weight_before
      from w window o as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
    c as (select *, cap * (weights - weight_before) <= weight * (total - cap_before) as capped from f),
    g as (
      select *, (sum(case when capped then cap else 0 end) over ())::bigint as cap_sum,
        (sum(case when capped then weight else 0 end) over ())::bigint as cap_weight
      from c),
    t as (
      select source, source_size,
        case when capped then cap::double else (weight * (total - cap_sum))::double / (weights - cap_weight) end as target
      from g),
    p as (
      select doc_id, source, size, coalesce(sum(size) over (partition by source order by draw, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d)
    select p.doc_id, p.size, t.source_size, t.target,
      (case when t.source_size = 0 then 0 else (floor(t.target)::bigint // t.source_size) * p.size
        + least(greatest(floor(t.target)::bigint % t.source_size - p.start, 0), p.size) end)::bigint as taken
    from p join t on p.source is not distinct from t.source
    """,
)
def op4(documents: DataFrame) -> DataFrame:
    pieces = mixing.mix_sources(documents)
    return (
        pieces.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word"))), F.lit(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


@query("op5_simhash", "documents")
def op5(documents: DataFrame) -> DataFrame:
    """SQL would need XXH64 and all pairs; tests hold it against a brute-force version."""
    found = simhash.near_duplicates(documents, words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@query(
    "op6_quality_rules",
    "documents",
    rf"""
    with w as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
    x as (
      select doc_id, row_number() over () as r, w, len(w)::bigint as n_words,
        length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
        len(list_filter(w, lambda v: regexp_matches(v, '^..', 's') and upper(v) = v and lower(v) <> v))::bigint as n_shouted
      from w),
    g as (select r, i, array_to_string(w[i:i + 7], ' ') as gram from (select r, w, unnest(range(1, n_words - 6)) as i from x where n_words >= 8)),
    twice as (select r, gram from g group by r, gram having count(*) > 1),
    covered as (select r, count(distinct i + k)::bigint as n from g join twice using (r, gram) cross join range(8) t(k) group by r),
    m as (
      select x.*, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
      from x left join covered c using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
      not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
        or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or 10 * n_shouted > 3 * n_words) as kept
    from m
    """,
)
def op6(documents: DataFrame) -> DataFrame:
    judged = quality.quality_rules(documents.select("doc_id", "text"), report=REPORT)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *REPORT, failed.alias("base_failed"), "kept")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file of the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_planes", "documents")
def op10(documents: DataFrame) -> DataFrame:
    """SQL has no tokenizer; tests hold it against the library's own ids."""
    return tokenfile.id_checksums(tokenfile.token_file_round_trip(documents, vocabulary("byte_bpe_50k.json")))


def _license_sql() -> str:
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
    grams = rf"""list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
    words = rf"""string_split(trim(regexp_replace(translate(text, '{licenses.UPPER}', '{licenses.SMALL}'), '[^a-z0-9]+', ' ', 'g')), ' ')"""
    return rf"""
    with lines as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
    cut as (select doc_id, place, regexp_split_to_array(text, '{licenses.SENTENCE_GAP}') as s from lines),
    paragraphs as (select doc_id, regexp_split_to_array(text, '{licenses.PARAGRAPH_GAP}') as p from documents),
    units as (
      select doc_id, 'line' as unit, place::int as place, 0::int as part, text from lines
      union all
      select doc_id, 'sentence', place::int, (generate_subscripts(s, 1) - 1)::int, unnest(s) from cut where len(s) > 1
      union all
      select * from (select doc_id, 'paragraph', (generate_subscripts(p, 1) - 1)::int, 0::int, unnest(p) as text from paragraphs) where contains(text, chr(10))),
    a as (select *, {grams} as g from (select *, {words} as w from units)),
    t as (select *, {grams} as g from (select *, {words} as w from (values {values}) v(template, license, text)))
    select a.doc_id, a.unit, a.place, a.part, t.license, t.template::int as template, len(a.g)::int as n_bigrams,
      2.0::double * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) as dice
    from a join t on len(a.g) between 0.6 * len(t.g) and 1.6 * len(t.g)
    where 2.0::double * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) >= {licenses.THRESHOLD}
    """


@query("op7_licenses", "documents", _license_sql())
def op7(documents: DataFrame) -> DataFrame:
    return licenses.scan_licenses(documents)


@query("op8_vantage_point_search", "embeddings")
def op8(embeddings: DataFrame) -> DataFrame:
    """The relaxed search; tests hold factor 1 against brute force and measure the recall of this one."""
    return ann.nearest_neighbours(embeddings, embeddings.where("vec_id % 100 = 0"), k=10)


@query("op2_pieces", "documents")
def op2(documents: DataFrame) -> DataFrame:
    """Sampled ids and their exact round trip; tests hold the draw against enumerated segmentations."""
    vocabulary_file = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(documents.select("doc_id", "text"), vocabulary_file, alpha=1.0, seed=2, checked="lossless")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


@query("op9_html_text", "pages")
def op9(pages: DataFrame) -> DataFrame:
    """SQL has no HTML parser; tests hold it against pages whose text is known."""
    return html.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op1_secrets", "documents")
def op1(documents: DataFrame) -> DataFrame:
    """The field cannot be written in SQL; tests hold the patterns and the decoding against brute force."""
    found = secrets.find_secrets(documents.select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(of("crf")).cast("long").alias("n_crf"),
    )


@query("op11_conversations", "conversations")
def op11(table: DataFrame) -> DataFrame:
    """SQL lacks crc32; tests hold the repair against an exhaustive search."""
    return conversations.audit_conversations(conversations.damage(table))


@query(
    "op12_collocations",
    "documents",
    r"""
    with p as (select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
    n as (select lang, sum(len(ws))::bigint as n from w group by lang),
    occurrences as (
      select lang, 1 as words, unnest(ws) as phrase from w
      union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
      union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from w),
    f as (select lang, phrase, any_value(words) as words, count(*) as f from occurrences group by lang, phrase having count(*) >= 10),
    cuts as (
      select lang, phrase, f as a, 1 as k, split_part(phrase, ' ', 1) as head, substr(phrase, strpos(phrase, ' ') + 1) as tail from f where words > 1
      union all select lang, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) from f where words = 3),
    scored as (
      select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, ((1000000::hugeint * c.a * c.a) // (h.f::hugeint * t.f))::bigint as score
      from cuts c join f h on h.lang = c.lang and h.phrase = c.head join f t on t.lang = c.lang and t.phrase = c.tail),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_pairs as (select lang, f, unnest([split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3)]) as phrase from f where words = 3),
    kept as (select * from best b where not exists (select 1 from inner_pairs i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.f >= 50 * b.a))
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
    from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
    """,
)
def op12(documents: DataFrame) -> DataFrame:
    return collocations.collocations(documents)


@query("op13_languages", "documents")
def op13(documents: DataFrame) -> DataFrame:
    """SQL has no k-means; tests hold the vectors against plain counting and the prediction against held-out labels."""
    apart = language.held_out(F.col("doc_id"))
    learned = language.fit(documents.where(~apart))
    found = language.identify(documents.withColumn("_apart", apart), learned, keep=("doc_id", "_apart"))
    return found.select("doc_id", F.col("_apart").alias("held_out"), F.col("near").alias("lang_pred"), "score", "rejected")

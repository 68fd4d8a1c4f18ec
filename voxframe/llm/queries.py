"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, genetic, hyperlang, licenses, linededup, media, ngramjoin, packing, periodic, sstable, urlcascade, wordpiece
from .common import documents


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page of its lines as paragraphs and a figure whose payload is resolved by digest.

    ``n_texts`` counts the page's text parts; those before the figure are its position.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    store = media.store_media(docs.select(media.padded(F.col("text")).alias("payload")))
    figure = F.concat(F.lit("<figure><img src='" + media.SCHEME), F.sha2(media.image(media.padded(F.col("text"))), 256), F.lit("'><figcaption>bytes "), n_bytes.cast("string"), F.lit("</figcaption></figure>"))
    pages = media.parse_pages(docs.select("doc_id", media.html_of(F.col("text"), figure).alias("html")))
    pages = pages.withColumn("n_texts", F.size(F.filter("parts", lambda p: p["kind"] == "text")).cast("long"))
    parts = media.resolve(pages, ["doc_id", "n_texts"], media.media_features(store)).where("kind = 'media'")
    return parts.select("doc_id", F.substring("caption", 7, 20).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pages as ordered parts, text and media references with their captions."""
    pages = media.parse_pages(documents(spark, sf_dir, "pages").select("page_id", F.col("html").cast("string").alias("html")))
    return pages.select("page_id", F.explode("parts").alias("p")).select("page_id", F.col("p.position").cast("long").alias("position"), "p.kind", "p.text", "p.digest", "p.caption")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer())


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences: only the assistant's turns bear loss."""
    return packing.pack_conversations(documents(spark, sf_dir, "conversations"), tokenizer())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), ["doc_id"]).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the scan alone, which SQL can express."""
    return licenses.scan(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, looked up in the shards of all documents by Bloom filter and binary search."""
    found = sstable.lookup(sstable.write_shards(documents(spark, sf_dir), tokenizer()), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda n, x: n + x).alias("id_sum"))


def op4_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shard_digests(sstable.write_shards(documents(spark, sf_dir), tokenizer()))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.dedup(docs).drop("text")


def line_dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup kept up to date: English documents first, then the others put in, then the toxic ones taken out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    toxic = documents(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    state = linededup.insert(linededup.build(docs.where(english)), docs.where(~english))
    state = linededup.delete(state, toxic)
    left = docs.drop("lang").join(toxic, "doc_id", "left_anti")
    return linededup.apply(left, state, state.postings).drop("text")


#: What marks a page's html as symbol junk; urls of such pages are the query's block list.
JUNK = "###"


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list is a table of its own: host and path of every page whose html is symbol junk."""
    pages = documents(spark, sf_dir, "pages")
    listed = pages.where(F.contains("html", F.lit(JUNK))).select(urlcascade.key_of(F.col("url").cast("string")).alias("key"))
    return urlcascade.judge(pages, listed)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_pieces(documents(spark, sf_dir), tokenizer())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    prototypes = hyperlang.fit(docs.where(~held))
    return hyperlang.predict(docs.select("doc_id", "text", held.alias("held_out")), prototypes).drop("text")


def op11_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic.pack_whole(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def tiled(doc_id: int, words: list[str]) -> list[str]:
    """Words of a tenth of the documents repeat from a place on with a period, both drawn from the doc_id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(spark, sf_dir), change=tiled)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_vector_packing, op3_license_scan, op4_sorted_string_tables, op5_decontamination, op6_ngram_jaccard, op7_line_dedup, op8_url_cascade, op9_token_counts, op10_language_id, op11_genetic_packing, op12_periodic_runs, op13_collocations, page_sequences, instruction_packing, line_dedup_replay, license_phrases, shard_lookup)}

#: The parts of a url; a null url is empty.
_URL = r"""
WITH u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
"""

#: Characters that are white space at a line's ends.
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND f.last_doc <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "license_phrases": f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, len(w) AS n, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'under' AND w[i + 2] = 'the' AND w[i + 3] = 'mit' AND w[i + 4] = 'license') AS a,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license' AND w[i + 3] = 'version' AND w[i + 4] = '2') AS b, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by' AND w[i + 3] = 'nc') AS c FROM w)
    SELECT doc_id, n::BIGINT AS n_words, (len(a) + len(b) + len(c))::BIGINT AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word,
        concat_ws(',', CASE WHEN len(b) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(a) > 0 THEN 'mit' END) AS base_labels FROM p""",
    "op6_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
    e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
    SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op7_line_dedup": _LINES
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "line_dedup_replay": _LINES.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", 1)
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op8_url_cascade": _URL
    + f""", listed AS (SELECT DISTINCT host || path AS key FROM h WHERE contains(html, '{JUNK}'))
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    key IS NOT NULL AS listed FROM r LEFT JOIN listed ON key = host || path""",
    "op12_periodic_runs": f"""WITH RECURSIVE h0 AS (SELECT DISTINCT doc_id, 4294967295::BIGINT AS c, 0 AS i FROM documents WHERE doc_id IS NOT NULL),
    crc AS (SELECT doc_id, c, i FROM h0 UNION ALL
        SELECT doc_id, xor(c >> 8, list_reduce(list_prepend(xor(c & 255, ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), i + 1 FROM crc WHERE i < len(doc_id::VARCHAR)),
    h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = len(doc_id::VARCHAR)),
    w AS (SELECT d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents d LEFT JOIN h USING (doc_id)),
    z AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) END AS p FROM w),
    t AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END) AS w FROM z),
    e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part, i FROM e),
    c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM s GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
    r AS (SELECT doc_id, s, n, min(q) AS q FROM c GROUP BY doc_id, s, n),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (n * 1.0) / q DESC, s, q) AS best FROM r),
    u AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
    g AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
    k AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i WHERE g.i IS NULL GROUP BY t.doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.n::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.n // b.q)::BIGINT AS exponent_milli,
        sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND best = 1 LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op13_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS ks(k))),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score FROM c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ') JOIN t ON t.lang = c.lang),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS lowest FROM s),
    o AS (SELECT DISTINCT c.lang, c.phrase FROM f c JOIN f x ON x.lang = c.lang AND x.k > c.k AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') WHERE c.k > 1),
    q AS (SELECT m.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m ANTI JOIN o USING (lang, phrase) WHERE lowest = 1)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000""",
}

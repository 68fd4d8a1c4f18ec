"""The same queries in DuckDB's SQL, written for themselves and not from the plans."""

from __future__ import annotations

from voxframe.constants import CONTRACTIONS

_WORDS = "list_filter(string_split(trim(regexp_replace({}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"

_TIMES = """et AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS t FROM events)"""

_SEGMENTS = """
pr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS w, value / 100 AS p, count(*) OVER (PARTITION BY user_id) * 32 / 1000.0::DOUBLE AS dur FROM events),
sp AS (SELECT *, w - row_number() OVER (PARTITION BY user_id ORDER BY w) AS g FROM pr WHERE p > 0.5),
ra AS (SELECT user_id, min(w) * 32 / 1000.0::DOUBLE AS a, CASE WHEN max(w) + 1 = round(max(dur) * 1000 / 32) THEN max(dur) ELSE (max(w) + 1) * 32 / 1000.0::DOUBLE END AS b, max(dur) AS dur FROM sp GROUP BY user_id, g),
mk AS (SELECT *, CASE WHEN (a - lag(b) OVER (PARTITION BY user_id ORDER BY a)) * 1000 < 200 THEN 0 ELSE 1 END AS fresh FROM ra),
mg AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a) AS m FROM mk),
me AS (SELECT user_id, min(a) AS a, max(b) AS b, max(dur) AS dur FROM mg GROUP BY user_id, m HAVING (max(b) - min(a)) * 1000 >= 250),
sg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS idx,
    greatest(coalesce((lag(b) OVER (PARTITION BY user_id ORDER BY a) + a) / 2, 0), a - 0.1) AS start_sec,
    least(coalesce((b + lead(a) OVER (PARTITION BY user_id ORDER BY a)) / 2, dur), b + 0.1) AS end_sec FROM me)
"""

_TIMED = "tt AS (SELECT conv_id, turn, turn * 4.0::DOUBLE AS s, turn * 4.0::DOUBLE + length(text) / 30.0::DOUBLE AS e, trim(text) AS text, role AS speaker FROM conversations WHERE trim(text) <> '')"

_NEXT = f"nx AS (SELECT * FROM (SELECT conv_id, turn, {_WORDS.format('lower(text)')} AS ref, lead({_WORDS.format('lower(text)')}) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations) WHERE hyp IS NOT NULL)"

#: Word errors of the pairs in nx: cells (i, j) of one anti-diagonal after the other, cost and substitutions; ties take the diagonal, then deletion.
_WER = f"""{_NEXT}, pr AS (SELECT row_number() OVER () AS k, conv_id, turn, ref, hyp, len(ref)::INT AS n, len(hyp)::INT AS m FROM nx),
dg AS (SELECT k, 0 AS d, [0] AS c2, [0] AS s2, [0] AS c1, [0] AS s1, n, m, ref, hyp FROM pr
    UNION ALL SELECT k, d + 1, c1, s1, list_transform(cells, lambda x: x[1]), list_transform(cells, lambda x: x[3]), n, m, ref, hyp FROM (
        SELECT *, list_transform(range(0, n + 1), lambda i: CASE WHEN i > d + 1 OR d + 1 - i > m THEN [1000000, 0, 0] WHEN i = 0 OR i = d + 1 THEN [d + 1, 0, 0] ELSE list_min([
            [c2[i] + (ref[i] <> hyp[d + 1 - i])::INT, 0, s2[i] + (ref[i] <> hyp[d + 1 - i])::INT], [c1[i] + 1, 1, s1[i]], [c1[i + 1] + 1, 2, s1[i + 1]]]) END) AS cells FROM dg WHERE d < n + m)),
we AS (SELECT pr.conv_id, pr.turn, dg.n, dg.m, c1[dg.n + 1] AS cost, s1[dg.n + 1] AS sub FROM dg JOIN pr USING (k) WHERE d = dg.n + dg.m)"""

#: Cues (conv_id, cue, a, b, speaker, ln): words of a chunk are wrapped by a fold that keeps the lines in one text.
_CUES = f"""{_TIMED},
cp AS (SELECT *, e - s AS dur, {_WORDS.format("text")} AS w, greatest(1, ceil(length(text) / 84), ceil(length(text) / (17 * greatest(e - s, 0.1))), ceil((e - s) / 7))::BIGINT AS n FROM tt),
cq AS (SELECT *, ceil(len(w) / n)::BIGINT AS each FROM cp),
cr AS (SELECT conv_id, turn, s, e, dur, speaker, unnest(CASE WHEN n = 1 THEN [0] ELSE generate_series(0, ceil(len(w) / each)::BIGINT - 1) END) AS i, n, w, each, text FROM cq),
cc AS (SELECT *, CASE WHEN n = 1 THEN w ELSE w[i * each + 1 : (i + 1) * each] END AS cw, CASE WHEN n = 1 THEN length(text) ELSE length(array_to_string(w[i * each + 1 : (i + 1) * each], ' ')) END AS ch FROM cr),
cd AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id, turn) AS al, sum(ch) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, lead(i) OVER (PARTITION BY conv_id, turn ORDER BY i) IS NULL AS fin FROM cc),
cg AS (SELECT conv_id, turn, i, speaker, cw, s + dur * (upto - ch) / al AS a, CASE WHEN fin THEN e ELSE s + dur * upto / al END AS b FROM cd),
cu AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS cue, a, CASE WHEN b - a < 1 THEN least(a + 1, coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY turn, i), 1e300)) ELSE b END AS b, speaker,
    string_split(list_reduce(cw, lambda x, y: CASE WHEN length(string_split(x, chr(10))[-1]) + 1 + length(y) <= 42 THEN x || ' ' || y ELSE x || chr(10) || y END), chr(10)) AS ln FROM cg)"""

_RUNS = """rn AS (SELECT l_returnflag || '/' || (l_suppkey % 7) AS model, l_linestatus AS backend, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'timeout' END AS status,
    l_extendedprice AS infer, l_discount + 0.1 AS rtf, CASE WHEN l_tax > 0.02 THEN l_tax * 1000 END AS load_ms, CASE WHEN l_tax > 0.04 THEN l_quantity END AS mem,
    l_quantity::INT % 5 AS sub, l_quantity::INT % 3 AS del, l_quantity::INT % 7 AS ins, l_quantity::INT AS ref_words, l_orderkey * 10 + l_linenumber AS seq
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _time(x: str, sep: str) -> str:
    return f"""(lpad(floor({x} / 3600)::BIGINT::VARCHAR, 2, '0') || ':' || lpad(floor(({x} % 3600) / 60)::BIGINT::VARCHAR, 2, '0') || ':' ||
    lpad((floor({x} % 60)::BIGINT + CASE WHEN floor(({x} - floor({x})) * 1000 + 0.5) = 1000 THEN 1 ELSE 0 END)::VARCHAR, 2, '0') || '{sep}' ||
    lpad((floor(({x} - floor({x})) * 1000 + 0.5)::BIGINT % 1000)::VARCHAR, 3, '0'))"""


def _contracted(x: str) -> str:
    for pattern, full in CONTRACTIONS:
        plain = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")
        x = f"regexp_replace({x}, '{plain}', '{full.replace('$1', chr(92) + '1')}', 'g')"
    return x


_LOW = f"CASE WHEN lang = 'en' THEN {_contracted('lower(text)')} ELSE lower(text) END"
_BARE = "replace(strip_accents(replace(regexp_replace(regexp_replace(low, '[-–—/_]+', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', '', 'g'), 'ñ', '')), '', 'ñ')"

ORACLES = {
    "text_normalize": f"SELECT doc_id, md5(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))) AS norm_md5 FROM (SELECT doc_id, {_LOW} AS low FROM documents)",
    "word_density": f"SELECT lang, sum(w)::BIGINT AS n_words, sum(c)::BIGINT AS n_chars, round(sum(w) * 1000.0 / sum(c), 6) AS per_1000, count(*) AS n_docs FROM (SELECT lang, len({_WORDS.format('text')}) AS w, length(text) AS c FROM documents) GROUP BY lang",
    "sentence_count": "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE 1 + len(regexp_extract_all(trim(text), '[.!?…]\\s+[¿¡\"''(\\p{Lu}]')) END AS n_sentences FROM documents",
    "manifest_violations": """SELECT page_id, unnest(list_filter([CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' END, CASE WHEN contains(url, '?') THEN 'has query' END,
        CASE WHEN trim(coalesce(html, '')) = '' THEN 'html empty' END, CASE WHEN regexp_matches(url, 'spam-farm|cheap-pills') THEN 'host blocked' END, CASE WHEN length(html) > 20000 THEN 'html long' END,
        CASE WHEN row_number() OVER (PARTITION BY page_id) > 1 THEN 'id repeated' END], lambda x: x IS NOT NULL)) AS problem FROM pages""",
    "speech_one_stream": """WITH p AS (SELECT event_id AS w, value / 100 AS p, lead(event_id) OVER (ORDER BY event_id) AS nx, (max(event_id) OVER () + 1) * 32 / 1000.0::DOUBLE AS dur FROM events),
    q AS (SELECT *, row_number() OVER (ORDER BY w) AS n FROM p), sp AS (SELECT *, n - row_number() OVER (ORDER BY w) AS g FROM q WHERE p > 0.5),
    ra AS (SELECT min(w) * 32 / 1000.0::DOUBLE AS a, CASE WHEN bool_or(nx IS NULL) THEN max(dur) ELSE (max(w) + 1) * 32 / 1000.0::DOUBLE END AS b, max(dur) AS dur FROM sp GROUP BY g),
    mk AS (SELECT *, CASE WHEN (a - lag(b) OVER (ORDER BY a)) * 1000 < 200 THEN 0 ELSE 1 END AS fresh FROM ra), mg AS (SELECT *, sum(fresh) OVER (ORDER BY a) AS m FROM mk),
    me AS (SELECT min(a) AS a, max(b) AS b, max(dur) AS dur FROM mg GROUP BY m HAVING (max(b) - min(a)) * 1000 >= 250)
    SELECT row_number() OVER (ORDER BY a) - 1 AS idx, round(greatest(coalesce((lag(b) OVER (ORDER BY a) + a) / 2, 0), a - 0.1), 6) AS start_sec,
        round(least(coalesce((b + lead(a) OVER (ORDER BY a)) / 2, dur), b + 0.1), 6) AS end_sec FROM me""",
    "speech_segments": f"WITH {_SEGMENTS} SELECT user_id, idx, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM sg",
    "speech_total": f"WITH {_SEGMENTS} SELECT user_id, round(sum(end_sec - start_sec), 6) AS speech_sec, count(*) AS n_segments FROM sg GROUP BY user_id",
    "blocks": f"""WITH RECURSIVE {_SEGMENTS},
        f AS (SELECT user_id, idx, start_sec, end_sec, 0::BIGINT AS block_id, CASE WHEN end_sec - start_sec > 1.0 THEN NULL ELSE start_sec END AS opened FROM sg WHERE idx = 0
        UNION ALL SELECT s.user_id, s.idx, s.start_sec, s.end_sec, f.block_id + CASE WHEN f.opened IS NULL OR s.end_sec - f.opened > 1.0 THEN 1 ELSE 0 END,
            CASE WHEN s.end_sec - s.start_sec > 1.0 THEN NULL WHEN f.opened IS NULL OR s.end_sec - f.opened > 1.0 THEN s.start_sec ELSE f.opened END
            FROM f JOIN sg s ON s.user_id = f.user_id AND s.idx = f.idx + 1)
        SELECT user_id, block_id, count(*) AS n_segments, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, round(sum(end_sec - start_sec), 6) AS speech_sec FROM f GROUP BY user_id, block_id""",
    "session_gap": """WITH m AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS g FROM m) SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY user_id, g""",
    "tumbling_energy": "SELECT epoch_us(ts) // 3600000000 AS hour, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM events GROUP BY 1",
    "sliding_windows": f"""WITH {_TIMES}, k AS (SELECT user_id, t / 3600 AS h FROM et) SELECT user_id, k, count(*) AS n FROM (SELECT user_id,
        unnest(generate_series(greatest(floor((h - 30) / 20) + 1, 0)::BIGINT, floor(h / 20)::BIGINT)) AS k FROM k) GROUP BY user_id, k""",
    "decode_windows": "SELECT doc_id, CASE WHEN length(text) / 15.0 <= 30 THEN 1 ELSE ceil((length(text) / 15.0::DOUBLE - 30) / 20)::BIGINT + 1 END AS n_windows FROM documents",
    "coverage_check": f"""SELECT conv_id, sum(w)::BIGINT AS total_words, round(sum(sec), 6) AS speech_sec, count(*) FILTER (WHERE w = 0) AS empty_segments, round(CASE WHEN sum(sec) > 0 THEN sum(w) / sum(sec) ELSE 0 END, 6) AS words_per_speech_sec,
        sum(sec) > 10 AND sum(w) / sum(sec) < 1.0 AS suspicious FROM (SELECT conv_id, len({_WORDS.format("text")}) AS w, length(text) / 30.0::DOUBLE AS sec FROM conversations) GROUP BY conv_id""",
    "bench_matrix": """SELECT m.model, b.backend, s_suppkey AS item FROM supplier, (SELECT DISTINCT l_returnflag AS model FROM lineitem) m, (SELECT DISTINCT l_linestatus AS backend FROM lineitem) b
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = m.model AND l.l_linestatus = b.backend AND l.l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount > 0.02)""",
    "run_summary": f"""WITH {_RUNS}, a AS (SELECT model, backend, count(*) FILTER (WHERE status = 'ok') AS k, count(*) AS n, bool_or(status = 'timeout') AS t, bool_or(status = 'error') AS e,
        sum(infer) FILTER (WHERE status = 'ok') AS i, sum(infer / rtf) FILTER (WHERE status = 'ok' AND infer <> 0 AND rtf <> 0) AS au, sum(sub + del + ins) FILTER (WHERE status = 'ok') AS er,
        sum(ins) FILTER (WHERE status = 'ok') AS ins, sum(ref_words) FILTER (WHERE status = 'ok') AS rw, max(mem) FILTER (WHERE status = 'ok') AS pk,
        arg_min(load_ms, seq) FILTER (WHERE status = 'ok' AND load_ms IS NOT NULL) AS ld FROM rn GROUP BY model, backend)
        SELECT model, backend, CASE WHEN k > 0 THEN 'ok' WHEN t THEN 'timeout' WHEN e THEN 'error' ELSE 'missing' END AS status, CASE WHEN k > 0 THEN k ELSE n END AS n, round(i / au, 6) AS rtf,
        round(er / rw, 6) AS wer, ins::BIGINT AS insertions, pk AS peak_mb, round(ld, 6) AS load_ms FROM a""",
    "run_failures": f"WITH {_RUNS} SELECT model, status, count(*) AS n FROM rn WHERE status IN ('error', 'timeout') GROUP BY model, status",
    "pivot_report": "SELECT n_nationkey AS nation, "
    + ", ".join(f"nullif(count(o_orderkey) FILTER (WHERE c_mktsegment = '{s}'), 0) AS {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey",
    "percentile_range": "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, count(*) AS n, count(*) < 2 AS single FROM lineitem GROUP BY ALL",
    "range_coverage": """WITH r AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
        SELECT l_returnflag, count(*) FILTER (WHERE l_extendedprice BETWEEN lo AND hi) AS inside, count(*) AS n FROM lineitem JOIN r USING (l_returnflag) WHERE l_linenumber >= 4 GROUP BY 1""",
    "ols_drift": f"""WITH {_TIMES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM et)
        SELECT user_id, round(median(value), 4) AS median_error, round(CASE WHEN max(t) > min(t) THEN regr_slope(value, t) ELSE 0 END * (max(t) - min(t)), 4) AS drift,
        round(avg(value) FILTER (WHERE i <= c // 3), 4) AS first_third, round(avg(value) FILTER (WHERE i > c - c // 3), 4) AS last_third, count(*) AS n FROM k GROUP BY user_id""",
    "last_n_median": "SELECT user_id, round(median(value), 6) AS median, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id",
    "decision_bands": "SELECT CASE WHEN l_discount * 10 < 0.4 THEN 'good' WHEN l_discount * 10 <= 0.8 THEN 'usable' ELSE 'slow' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
    "cosine_pairs": "SELECT a.vec_id // 40 AS meeting, a.vec_id AS a_vec_id, b.vec_id AS b_vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id // 40 = b.vec_id // 40 AND a.vec_id < b.vec_id",
    "label_gap": """WITH p AS (SELECT a.vec_id // 40 AS meeting, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id // 40 = b.vec_id // 40 AND a.vec_id < b.vec_id)
        SELECT meeting, count(*) AS n_pairs, round(avg(c) FILTER (WHERE same), 6) AS within, round(avg(c) FILTER (WHERE NOT same), 6) AS between, round(min(c) FILTER (WHERE same), 6) AS min_within,
        round(max(c) FILTER (WHERE NOT same), 6) AS max_between, round(avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same), 6) AS gap FROM p GROUP BY meeting""",
    "vocab_coverage": f"WITH {_NEXT} SELECT conv_id, turn, round(CASE WHEN len(ref) > 0 THEN len(list_filter(ref, lambda w: list_contains(hyp, w))) / len(ref) ELSE 0 END, 6) AS coverage, len(list_filter(hyp, lambda w: NOT list_contains(ref, w)))::BIGINT AS surplus FROM nx",
    "nearest_fill": f"""WITH {_TIMES}, l AS (SELECT user_id, idx, t, event_type AS label FROM et WHERE value > 60),
        p AS (SELECT e.user_id, e.idx, arg_min(l.label, (abs(l.t - e.t), l.idx)) AS near FROM et e JOIN l ON l.user_id = e.user_id WHERE e.value <= 60 GROUP BY e.user_id, e.idx)
        SELECT e.user_id, e.idx, CASE WHEN e.value > 60 THEN e.event_type ELSE coalesce(p.near, '0') END AS label FROM et e LEFT JOIN p ON p.user_id = e.user_id AND p.idx = e.idx""",
    "interval_overlap": f"""WITH {_TIMES}, m AS (SELECT a.user_id, a.idx, b.idx AS r_idx, least(a.t + 7200, b.t + 3600) - greatest(a.t, b.t - 3600) AS o FROM et a JOIN et b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.t < b.t + 3600 AND b.t - 3600 < a.t + 7200),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, idx ORDER BY o DESC, r_idx) AS r FROM m WHERE o > 0.5) SELECT user_id, idx, r_idx, round(o, 3) AS overlap_sec FROM k WHERE r = 1""",
    "active_segment": f"WITH {_TIMES} SELECT a.user_id, a.idx AS point, coalesce(min(b.idx), -1) AS active_idx FROM et a LEFT JOIN et b ON a.user_id = b.user_id AND b.event_type = 'click' AND a.t >= b.t AND a.t < b.t + 10000 GROUP BY a.user_id, a.idx",
    "der_totals": f"""WITH {_TIMES},
        n AS (SELECT user_id, max(floor((idx + 1.4) * 100 + 0.5))::BIGINT AS n FROM et GROUP BY user_id), fr AS (SELECT user_id, n, unnest(generate_series(0, n - 1)) AS f FROM n),
        rf AS (SELECT DISTINCT user_id, unnest(generate_series(floor(idx * 100 + 0.5)::BIGINT, floor((idx + 1.3) * 100 + 0.5)::BIGINT - 1)) AS f, event_type AS s FROM et),
        hf AS (SELECT DISTINCT user_id, unnest(generate_series(floor((idx + 0.1) * 100 + 0.5)::BIGINT, floor((idx + 1.4) * 100 + 0.5)::BIGINT - 1)) AS f, CASE WHEN value > 80 THEN 's0' ELSE event_type END AS s FROM et),
        ra AS (SELECT user_id, f, count(*) AS r, string_agg(s, ',' ORDER BY s) AS rs FROM rf GROUP BY ALL), ha AS (SELECT user_id, f, count(*) AS h FROM hf GROUP BY ALL),
        al AS (SELECT fr.user_id, fr.f, n, coalesce(r, 0) AS r, coalesce(h, 0) AS h, coalesce(rs, '') AS rs FROM fr LEFT JOIN ra USING (user_id, f) LEFT JOIN ha USING (user_id, f)),
        ch AS (SELECT user_id, f FROM (SELECT *, lag(rs) OVER (PARTITION BY user_id ORDER BY f) AS was FROM al) WHERE was IS NOT NULL AND was <> rs),
        co AS (SELECT DISTINCT user_id, unnest(generate_series(f - 5, f + 4)) AS f FROM ch),
        x AS (SELECT al.*, co.f IS NOT NULL AS c FROM al LEFT JOIN co ON co.user_id = al.user_id AND co.f = al.f)
        SELECT user_id, sum(CASE WHEN c THEN 0 ELSE r END)::BIGINT AS ref_frames, sum(CASE WHEN c THEN r ELSE 0 END)::BIGINT AS collar_frames, sum(CASE WHEN c THEN 0 ELSE greatest(r - h, 0) END)::BIGINT AS missed_frames,
        sum(CASE WHEN c THEN 0 ELSE greatest(h - r, 0) END)::BIGINT AS false_frames, sum(CASE WHEN c THEN 0 ELSE least(r, h) END)::BIGINT AS both_frames FROM x GROUP BY user_id""",
    "cue_times": f"""WITH {_TIMED},
        p AS (SELECT *, e - s AS dur, {_WORDS.format("text")} AS w, greatest(1, ceil(length(text) / 84), ceil(length(text) / (17 * greatest(e - s, 0.1))), ceil((e - s) / 7))::BIGINT AS n FROM tt),
        q AS (SELECT *, ceil(len(w) / n)::BIGINT AS each FROM p),
        r AS (SELECT conv_id, turn, s, e, dur, speaker, unnest(CASE WHEN n = 1 THEN [0] ELSE generate_series(0, ceil(len(w) / each)::BIGINT - 1) END) AS i, n, w, each, text FROM q),
        c AS (SELECT *, CASE WHEN n = 1 THEN length(text) ELSE length(array_to_string(w[i * each + 1 : (i + 1) * each], ' ')) END AS ch FROM r),
        d AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id, turn) AS al, sum(ch) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, lead(i) OVER (PARTITION BY conv_id, turn ORDER BY i) IS NULL AS fin FROM c),
        g AS (SELECT conv_id, turn, i, speaker, s + dur * (upto - ch) / al AS a, CASE WHEN fin THEN e ELSE s + dur * upto / al END AS b FROM d)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS cue, round(a, 6) AS start_sec,
        round(CASE WHEN b - a < 1 THEN least(a + 1, coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY turn, i), 1e300)) ELSE b END, 6) AS end_sec, speaker FROM g""",
    "csv_export": f"""WITH {_TIMED}, x AS (SELECT conv_id, turn, round(s::DECIMAL(20, 9), 3)::DECIMAL(20, 3)::VARCHAR || ',' || round(e::DECIMAL(20, 9), 3)::DECIMAL(20, 3)::VARCHAR || ',' || {_time("s", ".")} || ',' || {_time("e", ".")} || ',' || speaker || ',' ||
        CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS l FROM tt)
        SELECT conv_id, md5('﻿' || 'start_sec,end_sec,start,end,speaker,text' || chr(13) || chr(10) || string_agg(l, chr(13) || chr(10) ORDER BY turn) || chr(13) || chr(10)) AS body_md5 FROM x GROUP BY conv_id""",
    "text_export": f"""WITH {_TIMED}, x AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN speaker || ': ' ELSE '' END || text AS l FROM tt)
        SELECT conv_id, md5(string_agg(l, chr(10) ORDER BY turn)) AS body_md5 FROM x GROUP BY conv_id""",
    "speaker_change": f"WITH {_TIMED} SELECT conv_id, turn, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN speaker END AS shown FROM tt",
    "speaker_order": "SELECT *, place % 5 AS slot FROM (SELECT conv_id, role AS speaker, min(turn) AS first_idx, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS place FROM conversations GROUP BY conv_id, role)",
    "document_rows": f"WITH {_TIMED} SELECT conv_id, turn, substr({_time('s', '.')}, 1, 8) AS time, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN speaker END AS speaker FROM tt",
    "unique_names": """WITH x AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS b, regexp_extract(url, '://[^/?#]*/([a-z]+)/', 1) AS lang FROM pages), y AS (SELECT *, row_number() OVER (PARTITION BY lang, lower(b) ORDER BY page_id) AS n FROM x)
        SELECT page_id, CASE WHEN n = 1 THEN b ELSE b || ' (' || n || ')' END AS unique_name FROM y""",
    "resume_prefix": "SELECT l_orderkey AS order_key, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber < m GROUP BY 1",
    "merge_edit": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || quality END AS text, CASE WHEN toxic = 1 THEN 'toxic' ELSE source END AS speaker, l.doc_id IS NOT NULL AS edited FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "latest_version": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "top_k_recent": "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS day, o_totalprice FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 10",
    "prune_runs": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 3",
    "contained_turns": """WITH r AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS reference FROM conversations WHERE role <> 'user' GROUP BY conv_id)
        SELECT conv_id, count(*) FILTER (WHERE contains(reference, text)) AS inside, count(*) AS n, count(*) FILTER (WHERE contains(reference, text)) * 100 >= count(*) * 80 AS ok FROM conversations JOIN r USING (conv_id) GROUP BY conv_id""",
    "energy_pattern": f"""WITH {_TIMES}, x AS (SELECT user_id, floor(t / 400000)::INT AS sec, max(value) AS rms FROM et GROUP BY ALL)
        SELECT user_id, round(min(rms) FILTER (WHERE sec IN (1, 3)), 6) AS low_in, round(max(rms) FILTER (WHERE sec NOT IN (1, 3, 5)), 6) AS high_out,
        coalesce(min(rms) FILTER (WHERE sec IN (1, 3)) > 1.1 * max(rms) FILTER (WHERE sec NOT IN (1, 3, 5)), false) AS pattern_ok FROM x GROUP BY user_id""",
    "background_level": f"""WITH {_TIMES}, x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, idx) AS r, greatest(count(*) OVER (PARTITION BY user_id) // 10, 1) AS k FROM et)
        SELECT user_id, value AS background FROM x WHERE r = k // 2 + 1""",
    "speech_regions": f"""WITH {_TIMES}, o AS (SELECT user_id, idx FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM et) WHERE value >= top * 0.3),
        m AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) - 1 < 3 THEN 0 ELSE 1 END AS fresh FROM o), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM m)
        SELECT user_id, min(idx) AS first_w, max(idx) + 1 AS end_w FROM g GROUP BY user_id, g HAVING max(idx) + 1 - min(idx) >= 2""",
    "take_until": """SELECT p_brand, p_partkey FROM (SELECT *, coalesce(sum(p_size) OVER w, 0) + (count(*) OVER w) * 0.4::DOUBLE AS b FROM part WHERE p_size >= 5
        WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE b < 300""",
    "pick_diverse": "SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) ORDER BY r, s_nationkey LIMIT 40",
    "disjoint_bins": "SELECT p_partkey, floor(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200)::BIGINT AS bin FROM part",
    "monotone_progress": f"""WITH {_TIMES}, w AS (SELECT user_id, idx, value / 20 AS t, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY idx) THEN 1 ELSE 0 END AS b FROM et),
        k AS (SELECT *, least(sum(b) OVER (PARTITION BY user_id ORDER BY idx) * 20 + t, 300) AS a FROM w) SELECT user_id, idx AS seq, round(max(a) OVER (PARTITION BY user_id ORDER BY idx), 6) AS at_sec FROM k""",
    "clock_labels": """SELECT o_orderkey, CASE WHEN x >= 3600 THEN (x // 3600) || ':' || lpad(((x % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0')
        ELSE (x // 60) || ':' || lpad((x % 60)::VARCHAR, 2, '0') END AS clock FROM (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS x FROM orders)""",
    "set_operations": """SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "beyond_cube": f"WITH {_RUNS} SELECT backend, status, count(*) AS n, sum(ref_words)::BIGINT AS ref_words, grouping(backend, status)::BIGINT AS level FROM rn WHERE status = 'ok' GROUP BY CUBE (backend, status)",
    "beyond_ranks": """SELECT c_custkey, rank() OVER w AS rank, ntile(4) OVER w AS quartile, round(cume_dist() OVER w, 6) AS cume FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)""",
    "beyond_props": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT json_extract_string(props, '$.k')::BIGINT) AS k_distinct FROM events GROUP BY event_type",
    "run_load": "SELECT o_orderkey AS run_id, o_orderstatus, count(l_orderkey) AS n, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "run_detail": f"""WITH {_RUNS}, m AS (SELECT DISTINCT 'R/' || (s_suppkey % 9) AS model FROM supplier), a AS (SELECT model, backend, count(*) FILTER (WHERE status = 'ok') AS k, count(*) AS n, bool_or(status = 'timeout') AS t,
        sum(infer) FILTER (WHERE status = 'ok') AS i, sum(infer / rtf) FILTER (WHERE status = 'ok') AS au FROM rn GROUP BY model, backend)
        SELECT model, backend, CASE WHEN k > 0 THEN 'ok' WHEN t THEN 'timeout' ELSE 'error' END AS status, CASE WHEN k > 0 THEN k ELSE n END AS n, round(i / au, 6) AS rtf FROM a JOIN m USING (model)""",
    "recurrent_scores": """WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS w, value / 100 AS x FROM events),
    r AS (SELECT user_id, w, 0.9::DOUBLE * 0 + 0.1::DOUBLE * x AS s FROM p WHERE w = 0 UNION ALL SELECT p.user_id, p.w, 0.9::DOUBLE * r.s + 0.1::DOUBLE * p.x FROM r JOIN p ON p.user_id = r.user_id AND p.w = r.w + 1)
    SELECT user_id, w, round(s, 6) AS score FROM r""",
    "running_estimates": f"""WITH {_TIMES}, e AS (SELECT user_id, idx, t / 1000 AS el, idx * CASE WHEN user_id % 2 = 0 THEN 28.0::DOUBLE ELSE 26.0 END AS pc, CASE WHEN user_id % 3 = 0 THEN 0.7::DOUBLE END AS learned FROM et),
        g AS (SELECT *, CASE WHEN idx = 1 AND pc >= 27 THEN 'calibrado' WHEN idx > 0 AND idx % 5 = 0 AND pc > 30 AND el > 0 THEN 'refinado' END AS src FROM e),
        h AS (SELECT *, max(CASE WHEN src IS NOT NULL THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS at, max(CASE WHEN src = 'calibrado' THEN el END) OVER (PARTITION BY user_id ORDER BY idx) AS w FROM g),
        j AS (SELECT h.*, CASE WHEN a.idx IS NOT NULL THEN a.el / a.pc ELSE coalesce(h.learned, 0.5) END AS rtf, coalesce(a.src, CASE WHEN h.learned > 0 THEN 'aprendido' ELSE 'tabla' END) AS source FROM h LEFT JOIN g a ON a.user_id = h.user_id AND a.idx = h.at)
        SELECT user_id, idx, round(rtf, 6) AS rtf, source, round(greatest(0, 3000 - pc) * rtf, 4) AS remaining_sec, round(3000 * rtf, 4) AS total_sec, round(CASE WHEN source = 'refinado' AND rtf > 0 THEN w / (rtf * 30) END, 6) AS warmup FROM j""",
    "estimate_texts": """WITH x AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s, o_orderstatus = 'O' AS tab FROM orders),
        y AS (SELECT *, s // 3600 AS h, floor((s % 3600) / 60 + 0.5)::BIGINT AS mr, s / 10 AS lo, s / 8 AS hi, s * 1000 AS b FROM x)
        SELECT o_orderkey, CASE WHEN s < 45 THEN 'menos de un minuto' WHEN s < 90 THEN 'alrededor de un minuto' WHEN s < 3600 THEN 'alrededor de ' || floor(s / 60 + 0.5)::BIGINT || ' minutos' ELSE 'alrededor de ' || h || ' h' || CASE WHEN mr = 0 THEN '' ELSE ' ' || mr || ' min' END END
            || CASE WHEN tab THEN ' (estimación aproximada)' ELSE '' END AS wait,
        CASE WHEN s < 60 THEN s || ' segundos' WHEN s < 3600 THEN CASE WHEN s // 60 = 1 THEN '1 minuto' ELSE (s // 60) || ' minutos' END || CASE WHEN s % 60 = 0 THEN '' ELSE ' y ' || (s % 60) || ' s' END
            ELSE CASE WHEN h = 1 THEN '1 hora' ELSE h || ' horas' END || CASE WHEN s // 60 % 60 = 0 THEN '' ELSE ' y ' || (s // 60 % 60) || ' min' END END AS duration,
        CASE WHEN hi < 60 THEN CASE WHEN floor(lo + 0.5) = floor(hi + 0.5) THEN '' ELSE 'between ' || floor(lo + 0.5)::BIGINT || ' and ' END || floor(hi + 0.5)::BIGINT || CASE WHEN floor(hi + 0.5) = 1 THEN ' second' ELSE ' seconds' END
            ELSE (SELECT CASE WHEN a = z THEN 'about ' ELSE 'between ' || a || ' and ' END || z || CASE WHEN hi < 3600 THEN ' minute' ELSE ' hour' END || CASE WHEN z = 1 THEN '' ELSE 's' END
                FROM (SELECT a, greatest(a, floor(hi / u + 0.5)::BIGINT) AS z FROM (SELECT u, greatest(1, floor(lo / u + 0.5)::BIGINT) AS a FROM (SELECT CASE WHEN hi < 3600 THEN 60 ELSE 3600 END AS u)))) END AS between,
        CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN replace(format('{:,}', floor(b / 1024.0::DOUBLE + 0.5)::BIGINT), ',', '.') || ' KB' ELSE replace((floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10)::DECIMAL(18, 1)::VARCHAR, '.', ',') || ' MB' END AS size FROM y""",
    "mode_rows": """WITH d AS (SELECT s_suppkey, s_acctbal AS m, s_suppkey % 3 <> 0 AS gpu, CASE WHEN s_suppkey % 2 = 0 THEN 'old browser' END AS reason FROM supplier),
        b AS (SELECT d.*, (SELECT arg_min(r_name, r_regionkey) FROM region WHERE gpu AND r_regionkey > 0 AND (coalesce(m, 0) <= 0 OR 6000.0 - r_regionkey * 1000 <= m)) AS best FROM d)
        SELECT s_suppkey, 0::BIGINT AS place, 'rapido' AS mode, 'base' AS profile, NULL AS why FROM b UNION ALL SELECT s_suppkey, 1, 'equilibrado', 'small', NULL FROM b
        UNION ALL SELECT s_suppkey, 2, 'preciso', best, CASE WHEN best IS NULL THEN CASE WHEN gpu THEN 'no room' ELSE coalesce(reason, 'no gpu') END END FROM b""",
    "editor_totals": f"SELECT conv_id, sum(len({_WORDS.format('text')}))::BIGINT AS n_words, round(sum(length(text) / 30.0::DOUBLE), 6) AS speech_sec FROM conversations GROUP BY conv_id",
    "stored_bytes": "SELECT coalesce(sum(o_custkey) FILTER (WHERE o_orderstatus <> 'P'), 0)::BIGINT AS bytes FROM orders",
    "speech_bands": f"""WITH {_SEGMENTS}, l AS (SELECT user_id, max(dur) AS d, count(*) / 15 AS x FROM pr GROUP BY user_id), t AS (SELECT user_id, sum(end_sec - start_sec) / max(d) AS a, count(*) / max(x) AS b FROM sg JOIN l USING (user_id) GROUP BY user_id)
        SELECT user_id, round(a, 6) AS speech_share, round(b, 6) AS segment_ratio, a > 0.5 AND a < 0.98 AS share_ok, b > 0.6 AND b < 1.8 AS segments_ok FROM t""",
    "reference_bands": f"""WITH x AS (SELECT doc_id, len({_WORDS.format('text')}) AS w, n_chars / 17.0::DOUBLE AS s FROM documents), y AS (SELECT *, CASE WHEN s > 0 THEN w / s END AS r FROM x)
        SELECT doc_id, round(r, 6) AS words_per_sec, w > 50 AS enough, coalesce(r > 0.5 AND r < 6, false) AS rate_ok, coalesce(r > 1.0 AND r < 4.5, false) AS density_ok FROM y""",
    "manifest_rules": """WITH i AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN lang END AS id FROM documents), j AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY doc_id) AS n FROM i),
        p AS (SELECT source, unnest(list_filter([CASE WHEN id IS NULL THEN 'id missing' END, CASE WHEN trim(text) = '' THEN 'reference empty' END, CASE WHEN lang = 'de' THEN 'sha256 missing or malformed' END, CASE WHEN NOT n_chars > 0 THEN 'durationSec not above 0' END,
            CASE WHEN lang NOT IN ('es', 'en') THEN 'lang neither es nor en' END, CASE WHEN lang = 'es' THEN 'level not A, B or V' END, CASE WHEN lang = 'fr' THEN 'noisy without snrDb' END, CASE WHEN id IS NOT NULL AND n > 1 THEN 'id repeated' END], lambda x: x IS NOT NULL)) AS problem FROM j)
        SELECT source, problem, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'src3', 'version missing', 1""",
    "label_gap_control": """WITH r AS (SELECT *, vec_id // 40 AS meeting, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY md5(vec_id::VARCHAR), vec_id) AS j FROM embeddings),
        v AS (SELECT a.meeting, a.vec_id, a.embedding, b.label FROM r a JOIN r b ON a.meeting = b.meeting AND a.i = b.j),
        p AS (SELECT a.meeting, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM v a JOIN v b ON a.meeting = b.meeting AND a.vec_id < b.vec_id)
        SELECT meeting, count(*) AS n_pairs, round(avg(c) FILTER (WHERE same), 6) AS within, round(avg(c) FILTER (WHERE NOT same), 6) AS between, round(avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same), 6) AS gap FROM p GROUP BY meeting""",
    "resume_union": """WITH x AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) - 2 AS d FROM lineitem)
        SELECT l_orderkey AS order_key, count(*) AS n, string_agg(CASE WHEN d > 0 AND l_linenumber <= d THEN l_returnflag ELSE lower(l_returnflag) END, ' ' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS text, sum(l_quantity) AS speech_sec FROM x GROUP BY l_orderkey""",
    "log_tail": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 201",
    "language_pairs": "SELECT CASE WHEN lang = 'es' THEN 'es-en' END AS to_en, CASE WHEN lang = 'en' THEN 'en-es' END AS to_es, count(*) AS n FROM documents GROUP BY 1, 2",
    "opened_sessions": "SELECT conv_id AS session_id, count(*) AS n, CASE WHEN conv_id % 3 = 0 THEN 'video' ELSE 'audio' END AS media_kind, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE length(text) > 200), '') AS edited FROM conversations GROUP BY conv_id",
    "concat_clips": "SELECT vec_id // 40 AS meeting, sum(len(embedding))::BIGINT AS n, round(max(embedding[1]) FILTER (WHERE vec_id % 40 = 1)::DOUBLE, 5) AS second_clip FROM embeddings GROUP BY 1",
    "wer_pairs": f"WITH RECURSIVE {_WER} SELECT conv_id, turn, CASE WHEN n > 0 THEN cost / n WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0 END AS wer, sub, (cost - sub + n - m) // 2 AS del, cost - sub - (cost - sub + n - m) // 2 AS ins, n AS ref_words, m AS hyp_words FROM we",
    "wer_micro": f"""WITH RECURSIVE {_WER} SELECT conv_id, sum(sub)::BIGINT AS sub, sum((cost - sub + n - m) // 2)::BIGINT AS del, sum(cost - sub - (cost - sub + n - m) // 2)::BIGINT AS ins, sum(n)::BIGINT AS ref_words, sum(m)::BIGINT AS hyp_words, count(*) AS n,
        CASE WHEN sum(n) > 0 THEN sum(cost) / sum(n) WHEN sum(cost) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS wer FROM we GROUP BY conv_id""",
    "round_trip": f"""WITH RECURSIVE {_WER}, t AS (SELECT we.conv_id % 7 AS k, cost / we.n AS w, length(array_to_string(hyp, ' ')) / greatest(1, length(array_to_string(ref, ' '))) AS r FROM we JOIN nx ON nx.conv_id = we.conv_id AND nx.turn = we.turn WHERE we.n > 0)
        SELECT k, round(avg(w), 6) AS mean_wer, round(avg(r), 6) AS mean_ratio, count(*) AS n FROM t GROUP BY k""",
    "der": f"""WITH RECURSIVE {_TIMES},
        n AS (SELECT user_id, max(floor((idx + 1.4) * 100 + 0.5))::BIGINT AS n FROM et GROUP BY user_id), fr AS (SELECT user_id, n, unnest(generate_series(0, n - 1)) AS f FROM n),
        rf AS (SELECT DISTINCT user_id, unnest(generate_series(floor(idx * 100 + 0.5)::BIGINT, floor((idx + 1.3) * 100 + 0.5)::BIGINT - 1)) AS f, event_type AS s FROM et),
        hf AS (SELECT DISTINCT user_id, unnest(generate_series(floor((idx + 0.1) * 100 + 0.5)::BIGINT, floor((idx + 1.4) * 100 + 0.5)::BIGINT - 1)) AS f, CASE WHEN value > 80 THEN 's0' ELSE event_type END AS s FROM et),
        ra AS (SELECT user_id, f, count(*) AS r, string_agg(s, ',' ORDER BY s) AS rs FROM rf GROUP BY ALL), ha AS (SELECT user_id, f, count(*) AS h FROM hf GROUP BY ALL),
        al AS (SELECT fr.user_id, fr.f, n, coalesce(r, 0) AS r, coalesce(h, 0) AS h, coalesce(rs, '') AS rs FROM fr LEFT JOIN ra USING (user_id, f) LEFT JOIN ha USING (user_id, f)),
        ch AS (SELECT user_id, f FROM (SELECT *, lag(rs) OVER (PARTITION BY user_id ORDER BY f) AS was FROM al) WHERE was IS NOT NULL AND was <> rs),
        co AS (SELECT DISTINCT user_id, unnest(generate_series(f - 5, f + 4)) AS f FROM ch),
        x AS (SELECT al.*, co.f IS NOT NULL AS c FROM al LEFT JOIN co ON co.user_id = al.user_id AND co.f = al.f),
        t AS (SELECT user_id, sum(CASE WHEN c THEN 0 ELSE r END) AS rf, sum(CASE WHEN c THEN r ELSE 0 END) AS cf, sum(CASE WHEN c THEN 0 ELSE greatest(r - h, 0) END) AS mf, sum(CASE WHEN c THEN 0 ELSE greatest(h - r, 0) END) AS ff, sum(CASE WHEN c THEN 0 ELSE least(r, h) END) AS bf FROM x GROUP BY user_id),
        w AS (SELECT rf.user_id, rf.s AS rs, hf.s AS hs, count(*) AS n FROM rf JOIN hf ON hf.user_id = rf.user_id AND hf.f = rf.f JOIN x ON x.user_id = rf.user_id AND x.f = rf.f AND NOT x.c GROUP BY ALL),
        rl AS (SELECT user_id, rs, row_number() OVER (PARTITION BY user_id ORDER BY rs) AS k FROM (SELECT DISTINCT user_id, rs FROM w)),
        opt AS (SELECT rl.user_id, rl.k, w.hs, w.n FROM rl JOIN w ON w.user_id = rl.user_id AND w.rs = rl.rs UNION ALL SELECT user_id, k, NULL, 0 FROM rl),
        pick AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::VARCHAR[] AS used, 0::BIGINT AS total FROM rl
            UNION ALL SELECT p.user_id, p.k + 1, CASE WHEN o.hs IS NULL THEN p.used ELSE list_append(p.used, o.hs) END, p.total + o.n FROM pick p JOIN opt o ON o.user_id = p.user_id AND o.k = p.k + 1 AND (o.hs IS NULL OR NOT list_contains(p.used, o.hs))),
        best AS (SELECT user_id, max(total) AS ok FROM pick GROUP BY user_id)
        SELECT user_id, true AS measurable, round((mf + ff + bf - coalesce(ok, 0)) / rf, 6) AS der, round(mf / 100, 6) AS missed_sec, round(ff / 100, 6) AS false_sec, round((bf - coalesce(ok, 0)) / 100, 6) AS confusion_sec, round(rf / 100, 6) AS ref_sec, round(cf / 100, 6) AS collar_sec FROM t LEFT JOIN best USING (user_id)""",
    "cue_lines": f"""WITH {_CUES} SELECT conv_id, cue, array_to_string(ln[1:2], chr(10)) AS lines, coalesce(list_sum(list_transform(ln[3:], lambda x: len(string_split(x, ' ')))), 0)::BIGINT AS dropped_words FROM cu""",
    "srt_export": f"""WITH {_CUES} SELECT conv_id, string_agg(cue || chr(13) || chr(10) || {_time("a", ",")} || ' --> ' || {_time("b", ",")} || chr(13) || chr(10) || speaker || ': ' || array_to_string(ln[1:2], chr(13) || chr(10)), chr(13) || chr(10) || chr(13) || chr(10) ORDER BY cue) || chr(13) || chr(10) AS body FROM cu GROUP BY conv_id""",
    "vtt_export": f"""WITH {_CUES} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_time("a", ".")} || ' --> ' || {_time("b", ".")} || chr(10) || '<v ' || speaker || '>' || replace(replace(replace(array_to_string(ln[1:2], chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) || chr(10) ORDER BY cue) || chr(10) AS body FROM cu GROUP BY conv_id""",
    "align_text": f"""WITH x AS (SELECT conv_id, turn, trim(text) AS t, {_WORDS.format("text")} AS w, len({_WORDS.format("text")}) AS n FROM conversations),
        y AS (SELECT *, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '([.!?…])\\s+([¿¡"''(\\p{{Lu}}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END AS se, greatest(least(1, n), floor(n / 6 + 0.5))::BIGINT AS a FROM x),
        z AS (SELECT *, greatest(least(1, n - a), floor(n * 2 / 6 + 0.5), 0)::BIGINT AS b FROM y),
        p AS (SELECT conv_id, turn, CASE WHEN t = '' THEN ['', '', ''] WHEN len(se) = 3 THEN list_transform(se, lambda q: trim(q)) ELSE [array_to_string(w[1:a], ' '), array_to_string(w[a + 1:a + b], ' '), array_to_string(w[a + b + 1:], ' ')] END AS parts FROM z)
        SELECT conv_id, turn, unnest([0, 1, 2]) AS segment, unnest(parts) AS part FROM p""",
}

"""DuckDB SQL with the same rows as the registered queries, built from shared common table expressions."""

from __future__ import annotations


def _terms(text: str) -> str:
    broken = r"regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"
    parts = rf"list_filter(regexp_split_to_array({broken}, '[_.\-]+'), lambda p: p <> '')"
    runs = rf"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9][A-Za-z0-9_.\-]*'), lambda x: regexp_replace(x, '[_.\-]+$', '')), lambda x: x <> '')"
    return f"flatten(list_transform({runs}, lambda x: list_concat([lower(x)], CASE WHEN regexp_matches(x, '[A-Za-z]') AND len({parts}) > 1 THEN list_transform({parts}, lambda p: lower(p)) ELSE [] END)))"


_BUCKET = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64"

_CTES = {
    "docs": "SELECT 'doc/' || doc_id AS relative_path, text, source, doc_id FROM documents",
    "pieces": r"SELECT relative_path, unnest(regexp_extract_all(text, '\s+|\S+')) AS piece, unnest(range(len(regexp_extract_all(text, '\s+|\S+')))) AS p FROM docs",
    "placed": "SELECT relative_path, p, piece, sum(length(piece)) OVER (PARTITION BY relative_path ORDER BY p) AS stop FROM pieces",
    "tok": r"SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY p) - 1 AS i, stop - length(piece) AS start, stop, count(*) OVER (PARTITION BY relative_path) AS n FROM placed WHERE regexp_matches(piece, '\S')",
    "win": "SELECT relative_path, n, unnest(range(0, 1 + CASE WHEN n <= 64 THEN 0 ELSE CAST(ceil((n - 64) / 56.0) AS BIGINT) END)) AS w FROM (SELECT DISTINCT relative_path, n FROM tok)",
    "cut": "SELECT win.relative_path, w AS chunk_index, min(start) AS start_char, max(stop) AS end_char, count(*) AS token_count FROM win JOIN tok ON tok.relative_path = win.relative_path AND i >= w * 56 AND i < w * 56 + 64 GROUP BY win.relative_path, w",
    "chunks": "SELECT sha1(sha1(relative_path) || ':fixed:' || chunk_index) AS chunk_id, relative_path, chunk_index, start_char, end_char, token_count, substring(text, CAST(start_char + 1 AS BIGINT), CAST(end_char - start_char AS BIGINT)) AS text FROM cut JOIN docs USING (relative_path)",
    "lines": "SELECT relative_path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs",
    "line_at": "SELECT relative_path, i, sum(length(line) + 1) OVER (PARTITION BY relative_path ORDER BY i) - 1 AS stop, sum(length(line) + 1) OVER (PARTITION BY relative_path ORDER BY i) - 1 - length(line) AS start FROM lines",
    "docitems": "SELECT doc_id AS chunk_id, text FROM documents",
    "questions": "SELECT item_id AS query_id, text AS question, text AS quote FROM benchmark",
    "asked": f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_terms('question')}) AS term FROM questions) GROUP BY query_id, term",
    "sc": "SELECT query_id, chunk_id, round(exact, 6) AS score FROM (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS exact FROM post JOIN asked USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id) CROSS JOIN corp GROUP BY query_id, chunk_id) WHERE exact > 0",
    "dl": "SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY chunk_id",
    "raw": "SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post CROSS JOIN corp GROUP BY term",
    "idf": "SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw",
    "sparse": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 50",
    "cb": f"SELECT chunk_id, {_BUCKET} AS b, CAST(sum(tf) AS DOUBLE) AS c FROM post GROUP BY ALL",
    "cn": "SELECT chunk_id, sqrt(sum(c * c)) AS size FROM cb GROUP BY chunk_id",
    "qb": f"SELECT query_id, {_BUCKET} AS b, CAST(sum(times) AS DOUBLE) AS c FROM asked GROUP BY ALL",
    "qn": "SELECT query_id, sqrt(sum(c * c)) AS size FROM qb GROUP BY query_id",
    "dsc": "SELECT query_id, chunk_id, round(sum((cb.c / cn.size) * (qb.c / qn.size)), 6) AS score FROM cb JOIN cn USING (chunk_id) JOIN qb USING (b) JOIN qn USING (query_id) GROUP BY query_id, chunk_id",
    "dense": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dsc) WHERE rank <= 50",
    "ranked": "SELECT 'dense' AS retriever, query_id, chunk_id, score, rank FROM dense UNION ALL SELECT 'sparse', query_id, chunk_id, score, rank FROM sparse",
    "fscore": "SELECT query_id, chunk_id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM ranked GROUP BY query_id, chunk_id",
    "fused": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fscore",
    "arms": "SELECT arm, query_id AS question_id, rank, relative_path, start_char, end_char, token_count FROM (SELECT 'hybrid' AS arm, query_id, chunk_id, rank FROM fused WHERE rank <= 10 UNION ALL SELECT retriever, query_id, chunk_id, rank FROM ranked WHERE rank <= 10) JOIN chunks USING (chunk_id)",
    "spans": "SELECT item_id AS question_id, relative_path, strpos(docs.text, benchmark.text) - 1 AS s, strpos(docs.text, benchmark.text) - 1 + length(benchmark.text) AS e FROM docs JOIN benchmark ON contains(docs.text, benchmark.text) WHERE (length(docs.text) - length(replace(docs.text, benchmark.text, ''))) / length(benchmark.text) = 1",
    "cats": "SELECT question_id, count(*) AS n, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'lookup' END AS category FROM spans GROUP BY question_id",
    "hit": "SELECT arm, question_id, relative_path AS span, rank, greatest(start_char, s) AS s, least(end_char, e) AS e, e - s AS size FROM arms JOIN spans USING (question_id, relative_path) WHERE start_char < e AND end_char > s",
    "pre": "SELECT a.arm, a.question_id, a.span, a.rank AS depth, b.rank, b.s, b.e, b.size, max(b.e) OVER (PARTITION BY a.arm, a.question_id, a.span, a.rank ORDER BY b.s, b.e, b.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM hit a JOIN hit b ON a.arm = b.arm AND a.question_id = b.question_id AND a.span = b.span AND b.rank <= a.rank",
    "cov": "SELECT arm, question_id, span, depth, sum(greatest(0, e - greatest(s, coalesce(reached, s)))) / max(size) AS ratio FROM pre GROUP BY arm, question_id, span, depth",
    "deep": "SELECT arm, question_id, depth, CASE WHEN category = 'ambiguous' THEN max(ratio) ELSE sum(ratio) / any_value(n) END AS coverage FROM (SELECT d.arm, d.question_id, d.depth, c.span, max(c.ratio) AS ratio FROM (SELECT DISTINCT arm, question_id, depth FROM cov) d JOIN cov c ON c.arm = d.arm AND c.question_id = d.question_id AND c.depth <= d.depth GROUP BY ALL) JOIN cats USING (question_id) GROUP BY arm, question_id, depth, category",
    "firsthit": "SELECT arm, question_id, min(depth) AS first_hit_rank FROM deep WHERE coverage >= 1 - 1e-9 GROUP BY arm, question_id",
    "spent": "SELECT *, sum(token_count) OVER (PARTITION BY arm, question_id ORDER BY rank) AS spent FROM arms",
    "affordable": "SELECT arm, question_id, max(rank) AS last FROM spent WHERE spent <= 400 GROUP BY arm, question_id",
    "paid": "SELECT d.arm, d.question_id, bool_or(coverage >= 1 - 1e-9 AND depth <= last) AS budget_hit FROM deep d JOIN affordable USING (arm, question_id) GROUP BY d.arm, d.question_id",
    "scored": "SELECT a.arm, q.question_id, coalesce(first_hit_rank <= 1, false) AS hit_1, coalesce(first_hit_rank <= 3, false) AS hit_3, coalesce(first_hit_rank <= 5, false) AS hit_5, coalesce(first_hit_rank <= 10, false) AS hit_10, first_hit_rank, CASE WHEN first_hit_rank <= 10 THEN round(1.0 / first_hit_rank, 6) ELSE 0.0 END AS reciprocal_rank, coalesce(budget_hit, false) AS budget_hit FROM (SELECT DISTINCT arm FROM arms) a CROSS JOIN (SELECT DISTINCT question_id FROM spans) q LEFT JOIN firsthit f ON f.arm = a.arm AND f.question_id = q.question_id LEFT JOIN paid p ON p.arm = a.arm AND p.question_id = q.question_id",
    "top5": "SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 5",
    "seen": "SELECT query_id, max(dense.score) AS confidence FROM top5 JOIN dense USING (query_id, chunk_id) GROUP BY query_id",
    "agree": "SELECT f.query_id, (d.chunk_id IS NOT NULL AND s.chunk_id IS NOT NULL) AS both_agree FROM fused f LEFT JOIN dense d USING (query_id, chunk_id) LEFT JOIN sparse s USING (query_id, chunk_id) WHERE f.rank = 1",
    "ab": "SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels",
    "num": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, a, b FROM ab",
    "draws": "SELECT r, xor(c, c >> 16) % n AS i FROM (SELECT r, n, (xor(b, b >> 13) * 69621) % 2147483647 AS c FROM (SELECT r, n, (xor(a, a >> 15) * 48271) % 2147483647 AS b FROM (SELECT r, n, (r * 1000003 + j * 998244353 + 20260906) % 2147483647 AS a FROM range(10000) t(r) CROSS JOIN (SELECT i AS j, count(*) OVER () AS n FROM num))))",
    "own": "SELECT chunk_id AS query_id, relative_path AS asker, text AS question FROM chunks WHERE CAST(substr(relative_path, 5) AS BIGINT) % 100 = 0",
    "oqb": f"SELECT query_id, {_BUCKET} AS b, CAST(count(*) AS DOUBLE) AS c FROM (SELECT query_id, unnest({_terms('question')}) AS term FROM own) GROUP BY ALL",
    "oqn": "SELECT query_id, sqrt(sum(c * c)) AS size FROM oqb GROUP BY query_id",
    "onear": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum((cb.c / cn.size) * (oqb.c / oqn.size)), 6) AS score FROM cb JOIN cn USING (chunk_id) JOIN oqb USING (b) JOIN oqn USING (query_id) GROUP BY query_id, chunk_id)",
    "pieces_of": r"SELECT answer_id, s, k, max(k) OVER (PARTITION BY answer_id) AS last FROM (SELECT answer_id, trim(s) AS s, k FROM (SELECT answer_id, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT answer_id, flatten(list_transform(string_split(answer, chr(10)), lambda x: regexp_split_to_array(regexp_replace(trim(x), '([.!?])[ \t]+([A-Z\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS l FROM answers)) WHERE length(regexp_replace(regexp_replace(s, '\[\d+(\s*,\s*\d+)*\]', '', 'g'), '[^A-Za-z]', '', 'g')) >= 3)",
    "asks": "SELECT item_id AS id, text FROM benchmark",
    "tokens_used": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'gpt-4.1-mini' ELSE 'gpt-4.1-nano' END AS model, event_id % 5 = 0 AS cached, user_id AS input_tokens, greatest(0, event_id % 500 - event_id % 300) AS output_tokens, event_id % 300 AS thinking_tokens, CASE WHEN event_id % 2 = 0 THEN user_id / 1e6 * 0.4 + greatest(0, event_id % 500 - event_id % 300) / 1e6 * 1.6 ELSE user_id / 1e6 * 0.1 + greatest(0, event_id % 500 - event_id % 300) / 1e6 * 0.4 END AS cost_usd FROM events",
    "said": f"SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, regexp_replace(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t]+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1], '[.!?]+$', '') || ' [' || rank || '].' AS s FROM top5 JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE len(list_intersect({_terms('question')}, {_terms('text')})) > 0",
    "replied": "SELECT query_id, string_agg(s, ' ' ORDER BY rank) AS reply, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS used FROM said WHERE r <= 2 GROUP BY query_id",
    "outcomes": "SELECT q.query_id, q.quote, confidence, CASE WHEN both_agree IS NULL THEN 'no_results' WHEN confidence < 0.55 THEN 'low_confidence' WHEN reply IS NULL THEN 'insufficient_context' ELSE 'answered' END AS outcome, reply, used FROM questions q LEFT JOIN seen USING (query_id) LEFT JOIN agree USING (query_id) LEFT JOIN replied USING (query_id)",
    "shown": "SELECT query_id, string_agg('[' || rank || '] ' || relative_path || ' > chunk ' || chunk_index || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM top5 JOIN chunks USING (chunk_id) GROUP BY query_id",
    "judged": "SELECT query_id, quote, CASE WHEN outcome = 'answered' THEN reply ELSE '' END AS answer, coalesce(context, '') AS context FROM outcomes LEFT JOIN shown USING (query_id)",
    "answers": "SELECT conv_id || '-' || turn AS answer_id, text || ' [' || (length(text) % 7) || ', ' || (length(text) % 5 + 1) || '] `x[' || (length(text) % 3) || ']` Then more [2].' AS answer, length(text) AS n FROM conversations WHERE role = 'assistant'",
    "cited": "SELECT answer_id, CASE WHEN n % 7 = n % 5 + 1 THEN [n % 7] ELSE [n % 7, n % 5 + 1] END AS c0 FROM answers",
    "cites": "SELECT answer_id, CASE WHEN list_contains(c0, 2) THEN c0 ELSE list_append(c0, 2) END AS c FROM cited",
    "records": "SELECT doc_id AS question_id, source AS arm, CASE WHEN quality = 1 AND n_chars % 3 > 0 THEN 'CORRECT' WHEN n_chars % 2 = 0 THEN 'PARTIAL' ELSE 'INCORRECT' END AS verdict, toxic = 0 AS answerable, n_chars % 5 > 0 AS span_retrieved, n_chars % 7 > 0 AS answered, CASE WHEN n_chars % 4 > 0 THEN n_chars % 4 = 1 END AS grounded, n_chars % 6 AS citations, CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 0 END AS fabricated FROM labels JOIN documents USING (doc_id)",
    "failed": "SELECT *, CASE WHEN verdict = 'CORRECT' THEN 'none' WHEN NOT answerable THEN CASE WHEN answered THEN 'missing_refusal' ELSE 'none' END WHEN NOT span_retrieved THEN 'retrieval_miss' WHEN NOT answered THEN 'wrong_refusal' ELSE 'ignored_context' END AS failure FROM records",
    "dups": "SELECT doc_id AS chunk_id, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS duplicate_of FROM documents",
    "q100": "SELECT vec_id AS query_id, embedding AS qv, label AS query_label FROM embeddings WHERE vec_id % 100 = 0",
    "nn": "SELECT query_id, vec_id AS chunk_id, label, query_label, round(list_inner_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q100 CROSS JOIN embeddings",
    "nnr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM nn",
}


def _bm25(source: str) -> dict[str, str]:
    """The parts of the index that depend on what is indexed."""
    return {
        "post": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_terms('text')}) AS term FROM {source}) GROUP BY chunk_id, term",
        "corp": f"SELECT (SELECT count(*) FROM {source}) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM {source}) AS avgdl",
    }


_CHUNKS = ["docs", "pieces", "placed", "tok", "win", "cut", "chunks"]
_SPARSE = ["questions", "post", "dl", "corp", "raw", "idf", "asked", "sc", "sparse"]
_FUSED = [*_CHUNKS, *_SPARSE, "cb", "cn", "qb", "qn", "dsc", "dense", "ranked", "fscore", "fused"]
_ARMS = [*_FUSED, "arms"]
_SCORED = [*_ARMS, "spans", "cats", "hit", "pre", "cov", "deep", "firsthit", "spent", "affordable", "paid", "scored"]
_SEEN = [*_FUSED, "top5", "seen", "agree"]


def _with(names: list[str], body: str, source: str = "chunks") -> str:
    own = _CTES | _bm25(source)
    # every table is read more than once, so it is kept
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({own[n]})" for n in names) + " " + body


_MEANS = "count(*) AS questions, round(avg(CAST(hit_1 AS DOUBLE)), 6) AS recall_1, round(avg(CAST(hit_3 AS DOUBLE)), 6) AS recall_3, round(avg(CAST(hit_5 AS DOUBLE)), 6) AS recall_5, round(avg(CAST(hit_10 AS DOUBLE)), 6) AS recall_10, round(avg(reciprocal_rank), 6) AS mrr, round(avg(CAST(budget_hit AS DOUBLE)), 6) AS recall_budget"


def _joined(values: str) -> str:
    return f"array_to_string({values}, ',')"


def _fusion(weight: str, limit: int, extra: str = "", group: str = "") -> str:
    key = f"{group}, " if group else ""
    return f"SELECT {key}query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {key}query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT {key}query_id, chunk_id, round(sum({weight} / (60.0 + rank)), 9) AS score FROM ranked {extra} GROUP BY ALL)) WHERE rank <= {limit}"


def oracle_sql() -> dict[str, str]:
    sentence = r"regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+([A-Z\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    digests = "CASE WHEN length(text) % 4 = 1 THEN sha1(text || '!') ELSE sha1(text) END"
    overlap_terms = f"len(list_intersect(list_distinct({_terms('question')}), {_terms('text')})) / len(list_distinct({_terms('question')}))"
    return {
        "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY doc_id, term",
        "token_stats": f"SELECT doc_id, sum(tf) AS dl, count(*) AS distinct_terms, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY doc_id",
        "normalise_text": "SELECT doc_id, sha1(text || chr(10) || chr(10) || 'end') AS content_hash, length(text) + 5 AS n_chars FROM documents",
        "content_ids": "SELECT 'doc/' || doc_id AS relative_path, sha1('doc/' || doc_id) AS doc_id, sha1('doc/' || doc_id || '#' || source || ' > body#occurrence=1') AS section_id, sha1(sha1('doc/' || doc_id) || ':fixed:0') AS first_chunk_id FROM documents",
        "token_offsets": _with(_CHUNKS[:4], "SELECT CAST(substr(relative_path, 5) AS BIGINT) AS doc_id, count(*) AS tokens, sum(start) AS starts, sum(stop) AS stops FROM tok GROUP BY relative_path"),
        "fixed_chunks": _with(_CHUNKS, "SELECT chunk_id, relative_path, chunk_index, start_char, end_char, token_count, sha1(text) AS text_hash FROM chunks"),
        "chunk_stats": _with(_CHUNKS, "SELECT count(*) AS chunks, round(avg(token_count), 6) AS mean_tokens, list_sort(list(token_count))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_tokens, list_sort(list(token_count))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95_tokens, sum(token_count) AS total_tokens FROM chunks"),
        "chunk_sections": _with([*_CHUNKS, "lines", "line_at"], "SELECT chunk_id, count(i) AS sections, relative_path || '#' || min(i) AS first_section, coalesce('line ' || min(i), '') AS heading FROM (SELECT chunk_id, chunks.relative_path, i FROM chunks LEFT JOIN line_at l ON l.relative_path = chunks.relative_path AND l.start < end_char AND l.stop > start_char) GROUP BY chunk_id, relative_path"),
        "sentence_spans": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, length(sentence) AS n_chars, sha1(sentence) AS digest FROM (SELECT doc_id, unnest({sentence}) AS sentence, unnest(range(len({sentence}))) AS k FROM documents) WHERE trim(sentence) <> ''",
        "paragraph_spans": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS i, sha1(p) AS digest FROM (SELECT conv_id, turn, unnest([text, coalesce(nxt, '')]) AS p, unnest([0, 1]) AS k FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)) WHERE trim(p) <> ''",
        "bm25_term_stats": _with(["docitems", "post", "dl", "corp", "raw", "idf"], "SELECT term, df, round(idf, 6) AS idf FROM idf", "docitems"),
        "bm25_search": _with(["docitems", *_SPARSE], "SELECT query_id, chunk_id AS doc_id, score, rank FROM sparse WHERE rank <= 10", "docitems"),
        "bm25_batch": _with([*_CHUNKS, *_SPARSE], "SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10"),
        "dense_topk": _with(["q100", "nn", "nnr"], "SELECT query_id, chunk_id, score, rank FROM nnr WHERE rank <= 10"),
        "dense_label_precision": _with(["q100", "nn", "nnr"], "SELECT query_id, count(*) AS neighbours, round(avg(CAST(label = query_label AS DOUBLE)), 6) AS precision FROM nnr WHERE rank <= 11 AND query_id <> chunk_id GROUP BY query_id"),
        "multi_hop_pairs": _with(["q100", "nn", "nnr"], "SELECT query_id, label AS other, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM (SELECT query_id, label, count(*) AS n FROM nnr WHERE rank <= 50 AND label <> query_label GROUP BY query_id, label)) WHERE r = 1"),
        "rrf_hybrid": _with(_FUSED, "SELECT query_id, chunk_id, score, rank FROM fused WHERE rank <= 10"),
        "rrf_weighted": _with(_FUSED, _fusion("CASE WHEN retriever = 'dense' THEN 2.0 ELSE 1.0 END", 10)),
        "rrf_ablation": _with(_FUSED, _fusion("1.0", 10, group="retriever")),
        "rrf_breakdown": _with(_FUSED, "SELECT f.query_id, f.chunk_id, f.rank, d.rank AS dense_rank, s.rank AS sparse_rank, d.rank IS NOT NULL AND s.rank IS NOT NULL AS in_both FROM fused f LEFT JOIN dense d USING (query_id, chunk_id) LEFT JOIN sparse s USING (query_id, chunk_id) WHERE f.rank <= 10"),
        "weight_sweep": _with(_FUSED, _fusion("CASE WHEN retriever = 'dense' THEN weight ELSE 1.0 END", 5, "CROSS JOIN (SELECT CAST(unnest([0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]) AS DOUBLE) AS weight)", "weight")),
        "hydrate_ranked": _with([*_FUSED, "top5"], "SELECT query_id, rank, chunk_id, relative_path, chunk_index, sha1(text) AS text_hash FROM top5 JOIN chunks USING (chunk_id)"),
        "rerank_topk": _with(_FUSED, f"SELECT query_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round({overlap_terms}, 6) AS rerank_score FROM fused JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE rank <= 20)) WHERE rank <= 5"),
        "exact_dedup_document": "SELECT chunk_id, duplicate_of FROM (SELECT doc_id AS chunk_id, first_value(doc_id) OVER (PARTITION BY source, sha1(text) ORDER BY doc_id) AS duplicate_of FROM documents) WHERE chunk_id <> duplicate_of",
        "exact_dedup_corpus": _with(["dups"], "SELECT chunk_id, duplicate_of FROM dups WHERE chunk_id <> duplicate_of"),
        "dedup_summary": _with(["dups"], "SELECT count(*) AS examined, count(*) FILTER (chunk_id <> duplicate_of) AS exact, 0 AS near, count(*) FILTER (chunk_id = duplicate_of) AS kept, round(count(*) FILTER (chunk_id <> duplicate_of) / count(*), 6) AS share FROM dups"),
        "locate_quotes": _with(["docs", "spans"], "SELECT question_id, relative_path, 'located' AS status, s AS start_char, e AS end_char FROM spans"),
        "quote_ambiguity": _with(["questions"], "SELECT query_id, count(doc_id) AS documents, coalesce(sum(CAST((length(text) - length(replace(text, question, ''))) / length(question) AS BIGINT)), 0) AS occurrences FROM questions LEFT JOIN documents ON contains(text, question) GROUP BY query_id"),
        "ideal_pools": _with([*_CHUNKS, "spans"], "SELECT question_id, chunk_id, least(end_char, e) - greatest(start_char, s) AS overlap FROM chunks JOIN spans USING (relative_path) WHERE start_char < e AND end_char > s"),
        "unreachable": _with([*_CHUNKS, "spans"], "SELECT question_id, bool_or(coalesce(start_char < e AND end_char > s, false)) AS reachable FROM spans LEFT JOIN chunks USING (relative_path) GROUP BY question_id"),
        "span_coverage": _with(_SCORED[:-6], "SELECT arm, question_id, span, depth, round(ratio, 6) AS ratio FROM cov"),
        "recall_at_k": _with(_SCORED, "SELECT arm, question_id, hit_1, hit_3, hit_5, hit_10 FROM scored"),
        "mrr": _with(_SCORED, "SELECT arm, question_id, first_hit_rank, reciprocal_rank FROM scored"),
        "recall_at_budget": _with(_SCORED, "SELECT arm, question_id, budget_hit FROM scored"),
        "is_hit": _with([*_ARMS, "spans", "cats", "hit", "pre", "cov"], "SELECT a.arm, c.question_id, CASE WHEN c.category = 'ambiguous' THEN coalesce(g.good, 0) > 0 ELSE coalesce(g.good, 0) = c.n END AS hit FROM (SELECT DISTINCT arm FROM arms) a CROSS JOIN cats c LEFT JOIN (SELECT arm, question_id, count(*) FILTER (r >= 1) AS good FROM (SELECT arm, question_id, span, max(ratio) AS r FROM cov GROUP BY ALL) GROUP BY ALL) g ON g.arm = a.arm AND g.question_id = c.question_id"),
        "tier1_join": _with(_SCORED, "SELECT arm, CAST(question_id AS VARCHAR) AS question_id, hit_10 AS span_retrieved FROM scored UNION ALL SELECT 'other', CAST(question_id AS VARCHAR), false FROM scored WHERE arm = 'dense'"),
        "arm_report": "SELECT event_type AS arm, count(*) AS questions, round(avg(CAST(event_id % 7 = 0 AS DOUBLE)), 6) AS refusal_rate, count(*) FILTER (event_id % 5 <> 0) AS live, round(quantile_cont(value, 0.5) FILTER (event_id % 5 <> 0), 6) AS median_live_latency, round(sum(value / 1000), 6) AS cost_usd FROM events GROUP BY event_type",
        "judge_sample": _with(["records"], "SELECT question_id FROM (SELECT *, row_number() OVER (PARTITION BY priority, arm ORDER BY question_id) AS turn FROM (SELECT *, CASE WHEN NOT span_retrieved AND answerable THEN 0 WHEN NOT answerable THEN 1 ELSE 2 END AS priority FROM records)) ORDER BY priority, CASE WHEN priority = 2 THEN turn ELSE 0 END, CASE WHEN priority = 2 THEN arm ELSE '' END, question_id LIMIT 40"),
        "cheapest_judge": "SELECT * FROM (SELECT source AS judge, round(avg(quality), 6) AS kappa, sum(n_chars) AS cost_usd FROM labels JOIN documents USING (doc_id) GROUP BY source) WHERE kappa >= 0.60 ORDER BY cost_usd, judge LIMIT 1",
        "merged_verdicts": "SELECT doc_id AS question_id, CASE WHEN doc_id % 2 = 0 THEN 'CORRECT' WHEN toxic = 1 THEN 'INCORRECT' END AS human_verdict FROM labels",
        "usage_costs": _with(["tokens_used"], "SELECT event_id, input_tokens, output_tokens, thinking_tokens, round(cost_usd, 9) AS cost_usd FROM tokens_used"),
        "usage_ledger": _with(["tokens_used"], "SELECT model, count(*) FILTER (NOT cached) AS calls, count(*) FILTER (cached) AS cached_calls, sum(input_tokens) FILTER (NOT cached) AS input_tokens, sum(output_tokens) FILTER (NOT cached) AS output_tokens, round(sum(cost_usd) FILTER (NOT cached), 6) AS cost_usd FROM tokens_used GROUP BY model"),
        "reply_parsing": "SELECT item_id, CASE item_id % 3 WHEN 1 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS support, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS completeness, CASE item_id % 2 WHEN 0 THEN 'CORRECT' ELSE 'PARTIAL' END AS verdict, true AS grounded, 'it is ' || item_id AS reason FROM benchmark",
        "model_prompts": "SELECT item_id, sha1('QUESTION' || chr(10) || text || chr(10) || chr(10) || 'REFERENCE ANSWER' || chr(10) || CASE WHEN item_id % 2 = 0 THEN lower(text) ELSE '(none: the documents do not answer this question, so declining is correct)' END || chr(10) || chr(10) || 'ASSISTANT''S ANSWER' || chr(10) || 'so ' || text || chr(10) || chr(10) || 'CONTEXT THE ASSISTANT WAS SHOWN' || chr(10) || 'some context' || chr(10)) AS judge, sha1('CLAIM' || chr(10) || text || chr(10) || chr(10) || 'CITED PASSAGES' || chr(10) || '[2] b.md > A > B' || chr(10) || 'x ' || text || chr(10)) AS verifier FROM benchmark",
        "refusal_texts": _with([*_FUSED, "top5"], "SELECT query_id, sha1('low_confidence' || chr(10) || 'Closest passages:' || chr(10) || '- ' || array_to_string(list_slice(found, 1, 3), chr(10) || '- ') || chr(10) || 'Missing: the answer' || chr(10) || 'Documents to check: ' || array_to_string(list_slice(paths, 1, 3), ', ')) AS digest FROM (SELECT query_id, list(relative_path || ' > chunk ' || chunk_index ORDER BY rank) AS found FROM top5 JOIN chunks USING (chunk_id) GROUP BY query_id) JOIN (SELECT query_id, list(relative_path ORDER BY r) AS paths FROM (SELECT query_id, relative_path, min(rank) AS r FROM top5 JOIN chunks USING (chunk_id) GROUP BY ALL) GROUP BY query_id) USING (query_id)"),
        "interval_texts": "SELECT source, printf('%.3f [%.3f, %.3f]', m, a, b) AS interval, printf('%+.3f [%+.3f, %+.3f]', m, a - 0.5, b) || CASE WHEN a - 0.5 > 0 OR b < 0 THEN '*' ELSE ' ' END AS delta FROM (SELECT source, avg(n_chars) / 1000 AS m, min(n_chars) / 1000 AS a, max(n_chars) / 1000 AS b FROM documents GROUP BY source)",
        "eligible_sources": "SELECT source || '/' || doc_id AS relative_path FROM documents WHERE length(text) >= 1500 AND NOT starts_with(source || '/' || doc_id, 'src1/') AND NOT starts_with(source || '/' || doc_id, 'src2/9')",
        "golden_items": "SELECT item_id AS reply_id, i, CASE WHEN item_id % 3 = 0 THEN 'what of ' || item_id END AS question, CASE WHEN item_id % 3 = 0 THEN 'this' END AS answer, CASE WHEN item_id % 3 = 0 THEN 1 END AS spans, CASE WHEN item_id % 3 = 0 THEN sha1(text || chr(10) || chr(10) || '```py' || chr(10) || '\"x\"' || chr(10) || '```') END AS quote, CASE item_id % 3 WHEN 1 THEN 'block without a question' WHEN 2 THEN 'reply without blocks' END AS problem FROM benchmark CROSS JOIN range(2) t(i) WHERE i = 0 OR item_id % 3 = 0",
        "candidate_reasons": _with(["docs", "spans"], "SELECT DISTINCT question_id, CASE question_id % 4 WHEN 1 THEN 'quote not verbatim' WHEN 2 THEN 'lookup needs one span' END AS reason FROM spans"),
        "rejection_counts": _with(["docs", "spans"], "SELECT reason, count(*) AS n FROM (SELECT DISTINCT question_id, CASE question_id % 4 WHEN 1 THEN 'quote not verbatim' WHEN 2 THEN 'lookup needs one span' END AS reason FROM spans) WHERE reason IS NOT NULL GROUP BY reason"),
        "suspicious_no_answer": _with(_SEEN, "SELECT query_id AS question_id, round(confidence, 6) AS confidence FROM seen WHERE confidence >= 0.55"),
        "confusable_documents": _with([*_CHUNKS, "post", "cb", "cn", "own", "oqb", "oqn", "onear"], "SELECT asker AS relative_path, other, n FROM (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY n DESC, other) AS r FROM (SELECT asker, c.relative_path AS other, count(*) AS n FROM onear JOIN own USING (query_id) JOIN chunks c ON c.chunk_id = onear.chunk_id WHERE onear.rank <= 8 AND c.relative_path <> asker GROUP BY ALL)) WHERE r = 1"),
        "golden_shape": "SELECT question_id, error FROM (SELECT item_id AS question_id, CASE WHEN item_id % 5 = 0 AND item_id % 4 <> 1 THEN 'lookup needs one span' WHEN item_id % 5 = 1 AND item_id % 4 < 2 THEN 'multi_hop needs spans in two documents' WHEN item_id % 5 = 2 AND item_id % 4 < 2 THEN 'ambiguous needs two spans' WHEN item_id % 5 > 2 AND item_id % 4 > 0 THEN 'unanswerable questions have no spans' WHEN item_id % 2 = 1 AND item_id % 7 = 0 THEN 'held_out needs a source url' END AS error FROM benchmark) WHERE error IS NOT NULL",
        "golden_select": "SELECT item_id AS question_id, ['lookup', 'multi_hop', 'ambiguous'][item_id % 5 + 1] AS category FROM benchmark WHERE item_id % 2 = 0 AND item_id % 3 > 0 AND item_id % 5 < 3",
        "document_listing": _with(_CHUNKS[:6], "SELECT docs.relative_path, CASE WHEN source = 'src1' THEN 'ingested' ELSE 'processed' END AS origin, count(chunk_index) AS chunks FROM docs LEFT JOIN cut USING (relative_path) GROUP BY docs.relative_path, source"),
        "chunk_store": _with(_CHUNKS[:6], "SELECT relative_path, count(*) AS chunks, sum(token_count + CASE WHEN relative_path = 'doc/1' THEN 1000 ELSE 0 END) AS tokens FROM cut WHERE relative_path <> 'doc/0' GROUP BY relative_path"),
        "vector_store": _with(["q100", "nn"], "SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM nn WHERE label = 3) WHERE rank <= 5"),
        "vector_ids": "SELECT vec_id AS chunk_id FROM embeddings WHERE label = 3",
        "document_store": "SELECT 'doc/' || doc_id || '.txt' AS relative_path, CAST(doc_id AS VARCHAR) AS title, sha1(text) AS content_hash, 1 AS sections FROM documents",
        "upload_checks": "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 415 WHEN page_id % 3 = 0 THEN 422 ELSE 200 END AS status FROM pages",
        "split_claims": _with(["answers", "cited", "cites", "pieces_of"], f"SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY k) - 1 AS \"index\", s AS text, CASE WHEN k = last THEN {_joined('c')} ELSE '' END AS citations FROM pieces_of JOIN cites USING (answer_id)"),
        "citation_coverage": _with(["answers", "pieces_of"], "SELECT answer_id, count(*) AS claims, round(1.0 / count(*), 6) AS coverage FROM pieces_of GROUP BY answer_id"),
        "markdown_sections": "SELECT 'doc/' || doc_id || '.md' AS relative_path, source AS title, len(l) AS sections, sha1(array_to_string(l, chr(10) || chr(10))) AS content_hash FROM (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)",
        "ask_pipeline": _with([*_SEEN, "said", "replied", "outcomes"], "SELECT query_id, outcome, CASE WHEN outcome = 'answered' THEN reply END AS answer, round(confidence, 6) AS confidence, CASE WHEN outcome = 'answered' THEN used ELSE '' END AS citations FROM outcomes"),
        "judge_pipeline": _with([*_SEEN, "said", "replied", "outcomes", "shown", "judged"], f"SELECT query_id, CASE WHEN w >= 0.6 THEN 'CORRECT' WHEN w >= 0.25 THEN 'PARTIAL' ELSE 'INCORRECT' END AS verdict, coalesce(g, 0) >= 0.6 AS grounded FROM (SELECT query_id, len(list_intersect(list_distinct({_terms('quote')}), {_terms('answer')})) / nullif(len(list_distinct({_terms('quote')})), 0) AS w, len(list_intersect(list_distinct({_terms('answer')}), {_terms('context')})) / nullif(len(list_distinct({_terms('answer')})), 0) AS g FROM judged)"),
        "arm_grid": _with(_SCORED, f"SELECT arm, {_MEANS} FROM scored GROUP BY arm"),
        "arm_by_category": _with(_SCORED, f"SELECT arm, category, {_MEANS} FROM scored JOIN cats USING (question_id) GROUP BY arm, category"),
        "leader_arm": _with(_SCORED, f"SELECT arm, recall_5, mrr FROM (SELECT arm, {_MEANS} FROM scored GROUP BY arm) ORDER BY recall_5 DESC, mrr DESC, arm LIMIT 1"),
        "metrics_grouping_sets": _with(_SCORED, "SELECT arm, coalesce(category, 'all') AS slice, count(*) AS questions, round(avg(CAST(hit_5 AS DOUBLE)), 6) AS recall_5 FROM scored JOIN cats USING (question_id) GROUP BY GROUPING SETS ((arm), (arm, category))"),
        "distractor_rate": _with(_ARMS, "SELECT arm, round(avg(CAST(relative_path = 'doc/0' AS DOUBLE)), 6) AS rate FROM arms WHERE rank <= 5 GROUP BY arm"),
        "bootstrap_ci": _with(["ab", "num", "draws"], "SELECT (SELECT count(*) FROM ab) AS n, (SELECT round(avg(a), 6) FROM ab) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT r, avg(CAST(a AS DOUBLE)) AS m FROM draws JOIN num USING (i) GROUP BY r)"),
        "paired_delta": _with(["ab", "num", "draws"], "SELECT (SELECT count(*) FROM ab) AS n, (SELECT round(avg(CAST(a - b AS DOUBLE)), 6) FROM ab) AS delta, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CAST(m > 0 AS DOUBLE)), 6) AS p_positive, round(quantile_cont(m, 0.025), 6) > 0 OR round(quantile_cont(m, 0.975), 6) < 0 AS significant FROM (SELECT r, avg(CAST(a - b AS DOUBLE)) AS m FROM draws JOIN num USING (i) GROUP BY r)"),
        "kappa": _with(["ab"], "SELECT n, round(o, 6) AS raw_agreement, round(x, 6) AS expected, round(CASE WHEN x >= 1 THEN 1.0 ELSE (o - x) / (1 - x) END, 6) AS kappa FROM (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS o, avg(CAST(a AS DOUBLE)) * avg(CAST(b AS DOUBLE)) + (1 - avg(CAST(a AS DOUBLE))) * (1 - avg(CAST(b AS DOUBLE))) AS x FROM ab)"),
        "bootstrap_kappa": _with(["ab", "num", "draws"], "SELECT round(quantile_cont(k, 0.025), 6) AS low, round(quantile_cont(k, 0.975), 6) AS high FROM (SELECT CASE WHEN x * y + (1 - x) * (1 - y) >= 1 THEN 1.0 ELSE (o - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))) END AS k FROM (SELECT r, avg(CAST(a = b AS DOUBLE)) AS o, avg(CAST(a AS DOUBLE)) AS x, avg(CAST(b AS DOUBLE)) AS y FROM draws JOIN num USING (i) GROUP BY r))"),
        "label_agreement": _with(["ab"], "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, a = b AS agree FROM ab"),
        "refusal_gate": _with(_SEEN, "SELECT q.query_id, round(confidence, 6) AS confidence, CASE WHEN both_agree IS NULL THEN 'no_results' WHEN confidence < 0.55 THEN 'low_confidence' END AS refusal, coalesce(both_agree, false) AS both_agree FROM questions q LEFT JOIN seen USING (query_id) LEFT JOIN agree USING (query_id)"),
        "refusal_calibration": _with([*_SEEN, "spans"], "SELECT 'hybrid' AS arm, round(min(confidence) FILTER (good), 6) AS answerable_min, round(avg(confidence) FILTER (good), 6) AS answerable_mean, round(max(confidence) FILTER (NOT good), 6) AS unanswerable_max, round(avg(confidence) FILTER (good) - avg(confidence) FILTER (NOT good), 6) AS gap, count(*) FILTER (good AND confidence < 0.55) AS false_refusals, count(*) FILTER (NOT good AND confidence < 0.55) AS catches FROM (SELECT confidence, query_id IN (SELECT question_id FROM spans) AS good FROM seen WHERE confidence IS NOT NULL)"),
        "near_misses": _with([*_FUSED, "top5"], "SELECT q.query_id, array_to_string(list_slice(list(t.relative_path || ' > chunk ' || t.chunk_index ORDER BY t.rank), 1, 3), '|') AS found, array_to_string(list_slice((SELECT list(relative_path ORDER BY r) FROM (SELECT c.relative_path, min(x.rank) AS r FROM top5 x JOIN chunks c USING (chunk_id) WHERE x.query_id = q.query_id GROUP BY c.relative_path)), 1, 3), '|') AS documents_to_check FROM questions q JOIN (SELECT query_id, rank, relative_path, chunk_index FROM top5 JOIN chunks USING (chunk_id)) t USING (query_id) GROUP BY q.query_id"),
        "confidence_composite": _with(_SEEN, "SELECT q.query_id, round(CASE WHEN both_agree AND confidence IS NOT NULL THEN (1.0 + least(1.0, greatest(0.0, (confidence - 0.3) / 0.4))) / 2 WHEN both_agree THEN 1.0 ELSE least(1.0, greatest(0.0, (confidence - 0.3) / 0.4)) END, 8) AS score, CASE WHEN both_agree AND confidence IS NOT NULL THEN 'agreement,retrieval' WHEN both_agree THEN 'agreement' WHEN confidence IS NOT NULL THEN 'retrieval' ELSE '' END AS components FROM questions q LEFT JOIN seen USING (query_id) LEFT JOIN agree USING (query_id)"),
        "render_context": _with([*_FUSED, "top5"], "SELECT query_id, length(p) AS n_chars, sha1(p) AS digest FROM (SELECT q.query_id, 'CONTEXT' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || relative_path || ' > chunk ' || chunk_index || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'QUESTION' || chr(10) || chr(10) || any_value(question) AS p FROM top5 JOIN chunks USING (chunk_id) JOIN questions q USING (query_id) WHERE rank <= 3 GROUP BY q.query_id)"),
        "parse_citations": _with(["answers", "cited", "cites"], f"SELECT answer_id, {_joined('c')} AS cited FROM cites"),
        "resolve_citations": _with(["answers", "cited", "cites"], f"SELECT answer_id, {_joined('list_filter(c, lambda x: x BETWEEN 1 AND 4)')} AS resolved, {_joined('list_filter(c, lambda x: NOT x BETWEEN 1 AND 4)')} AS unresolved, {_joined('list_filter([1, 2, 3, 4], lambda x: NOT list_contains(c, x))')} AS uncited FROM cites"),
        "failure_attribution": _with(["records", "failed"], "SELECT question_id, verdict, failure FROM failed"),
        "failure_pivot": _with(["records", "failed"], "SELECT arm, " + ", ".join(f"count(*) FILTER (failure = '{f}') AS {f}" for f in ("none", "retrieval_miss", "wrong_refusal", "ignored_context", "missing_refusal")) + " FROM failed GROUP BY arm"),
        "quality_series": _with(["records"], "SELECT arm, round(avg(CAST(verdict = 'CORRECT' AS DOUBLE)), 6) AS correct, round(avg(CAST(verdict IN ('CORRECT', 'PARTIAL') AS DOUBLE)), 6) AS correct_or_partial, round(avg(coalesce(CAST(grounded AS DOUBLE), 0.0)), 6) AS grounded_score, round(avg(CAST(citations > 0 AND fabricated = 0 AS DOUBLE)), 6) AS cited_honestly FROM records GROUP BY arm"),
        "document_summary": _with(_CHUNKS[:6], "SELECT docs.relative_path, count(chunk_index) AS chunks FROM docs LEFT JOIN cut USING (relative_path) GROUP BY docs.relative_path"),
        "html_text": r"SELECT page_id, regexp_extract(bare, '(?is)<title>(.*?)</title>', 1) AS title, length(body) AS n_chars, sha1(body) AS digest FROM (SELECT page_id, bare, trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<noscript\b.*?</noscript>', '', 'g') AS bare FROM pages))",
        "include_expansion": "SELECT 'doc/' || d.doc_id AS relative_path, length(t) AS n_chars, sha1(t) AS digest FROM (SELECT d.doc_id, 'intro' || coalesce(chr(10) || '```txt' || chr(10) || regexp_replace(a.text, '\\n+$', '') || chr(10) || '```', '') || chr(10) || 'mid' || coalesce(chr(10) || '```txt' || chr(10) || regexp_replace(b.text, '\\n+$', '') || chr(10) || '```', '') AS t FROM documents d LEFT JOIN documents a ON a.doc_id = d.doc_id + 1 LEFT JOIN documents b ON b.doc_id = d.doc_id + 2) d",
        "stale_documents": f"SELECT 'doc/' || doc_id AS relative_path, CASE length(text) % 4 WHEN 0 THEN 'new' WHEN 2 THEN 'deleted' ELSE 'edited' END AS change FROM documents WHERE length(text) % 4 <> 3 AND {digests} IS NOT NULL",
        "last_write_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
        "upsert_latest": "SELECT 'doc/' || doc_id AS chunk_id, sha1(CASE WHEN source = 'src1' THEN text || '+' ELSE text END) AS digest FROM documents",
        "delete_document": _with(_CHUNKS[:6], "SELECT count(*) FILTER (relative_path <> 'doc/0') AS chunks_left, count(*) FILTER (relative_path = 'doc/0') AS deleted FROM cut"),
        "index_consistency": "SELECT held_by, missing_in, chunk_id FROM (SELECT 'doc/' || doc_id AS chunk_id, length(text) % 10 <> 0 AS d, length(text) % 15 <> 0 AS s FROM documents), (VALUES ('store', 'dense'), ('store', 'sparse'), ('dense', 'sparse'), ('sparse', 'dense')) p(held_by, missing_in) WHERE CASE held_by WHEN 'dense' THEN d WHEN 'sparse' THEN s ELSE true END AND NOT CASE missing_in WHEN 'dense' THEN d WHEN 'sparse' THEN s END",
        "cost_by_window": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2",
    }

"""The same results in plain SQL (DuckDB dialect), written independently of the
Spark code: global windows and one-row-per-token tables instead of buckets and
arrays."""

from __future__ import annotations


def norm(s: str) -> str:
    """Normalised answer; articles twice, as neighbours share a separator."""
    bare = f"regexp_replace(lower({s}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    once = f"regexp_replace({bare}, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g')"
    twice = f"regexp_replace({once}, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({twice}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def words(s: str) -> str:
    return f"regexp_extract_all({s}, '\\S+')"


QA = """
docs AS (SELECT doc_id, lang, source, text, string_split(text, ' ') AS w FROM documents),
qs AS (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS q FROM docs),
ks AS (SELECT *, (doc_id*7 + q*3) % len(w) AS k, (doc_id*7 + (q+1)*3) % len(w) AS k2 FROM qs),
qa AS (
  SELECT doc_id*4 + q AS seq, doc_id, lang, source AS title, text AS context,
    'where is ' || w[k+1] || ' in ' || source || ' ?' AS question,
    w[k+1] AS answer,
    len(array_to_string(w[1:k], ' ')) + (CASE WHEN k > 0 THEN 1 ELSE 0 END) AS answer_start,
    CASE WHEN q < doc_id % 3 THEN [w[k+1], w[k2+1]] ELSE [w[k+1]] END AS golds
  FROM ks)"""

NOISY = QA + """,
noisy AS (SELECT seq, doc_id, lang, context, question, answer, answer_start + doc_id % 4 AS answer_start FROM qa)"""

PREDICTIONS = QA + """,
predictions AS (
  SELECT seq, doc_id, lang, golds,
    CASE doc_id % 5 WHEN 0 THEN answer WHEN 1 THEN translate(answer, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!'
      WHEN 2 THEN 'the ' || answer || ' ' || answer || ' extra'
      WHEN 3 THEN substring(context, answer_start + 1, 40) ELSE '' END AS pred
  FROM qa)"""

SCORED = PREDICTIONS + f""",
pairs AS (
  SELECT seq, lang, i, {norm('pred')} AS p, {norm('gold')} AS g
  FROM (SELECT seq, lang, pred, unnest(golds) AS gold, generate_subscripts(golds, 1) AS i FROM predictions)),
pt AS (SELECT seq, i, t, count(*) AS c FROM (SELECT seq, i, unnest(string_split(p, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
gt AS (SELECT seq, i, t, count(*) AS c FROM (SELECT seq, i, unnest(string_split(g, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
pn AS (SELECT seq, i, sum(c) AS n FROM pt GROUP BY ALL),
gn AS (SELECT seq, i, sum(c) AS n FROM gt GROUP BY ALL),
sh AS (SELECT seq, i, sum(least(pt.c, gt.c)) AS s FROM pt JOIN gt USING (seq, i, t) GROUP BY ALL),
each AS (
  SELECT pairs.seq, lang, CASE WHEN p = g THEN 1 ELSE 0 END AS em,
    CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE 2 * (s::DOUBLE/pn.n) * (s::DOUBLE/gn.n) / ((s::DOUBLE/pn.n) + (s::DOUBLE/gn.n)) END AS f1
  FROM pairs LEFT JOIN sh USING (seq, i) LEFT JOIN pn USING (seq, i) LEFT JOIN gn USING (seq, i)),
best AS (SELECT seq, lang, max(em) AS em, max(f1) AS f1 FROM each GROUP BY ALL)"""

KEPT = QA + """,
seen AS (
  SELECT *, lag(context) OVER w AS before, row_number() OVER w AS rn,
    last_value(context) OVER (PARTITION BY lang ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM qa WINDOW w AS (PARTITION BY lang ORDER BY seq)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seq) - 1 AS idx
  FROM seen WHERE context IS DISTINCT FROM (CASE WHEN rn = 1 THEN final ELSE before END))"""

TRIVIA = f"""
trivia AS (
  SELECT doc_id, replace(text, chr(10), ' ') AS context, {words('text')}[1] AS first FROM documents),
flat AS (
  SELECT doc_id, 'which ' || first AS question, context, [first || '.', lower(first)] AS targets, lower(first) AS norm_target
  FROM trivia)"""

TOKENS = f"""
tok AS (
  SELECT doc_id, pos, tok FROM (
    SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos
    FROM (SELECT doc_id, {words('text')} AS w FROM documents)))"""

VOCAB = TOKENS + """,
voc AS (
  SELECT tok AS token, row_number() OVER (ORDER BY n DESC, tok) + 4 AS token_id, n FROM (
    SELECT tok, count(*) AS n FROM tok GROUP BY tok ORDER BY n DESC, tok LIMIT 5000))"""
ALL_WORDS = VOCAB.replace(" ORDER BY n DESC, tok LIMIT 5000", "")

IDS = ALL_WORDS + """,
ids AS (SELECT doc_id, pos, tok, coalesce(token_id, 3) AS id FROM tok LEFT JOIN voc ON tok = token)"""

BLOCKS = IDS + """,
stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM ids),
filled AS (SELECT g // 510 AS block_id, list(id ORDER BY g) AS l FROM stream GROUP BY 1 HAVING count(*) = 510),
blocks AS (SELECT block_id, list_concat([0], l, [2]) AS ids FROM filled)"""


def aligned(source: str, fold: bool = False) -> str:
    def at(shift: int) -> str:
        piece = f"substring(context, (answer_start - {shift} + 1)::BIGINT, len(answer)::BIGINT)"
        if fold:
            piece = f"lower({piece})"
        return f"WHEN answer_start >= {shift} AND {piece} = answer THEN answer_start - {shift}"

    return f"""
al AS (SELECT *, s + len(answer) AS e FROM (
  SELECT *, CASE {at(0)} {at(1)} {at(2)} END AS s FROM {source}))"""


def token_at(at: str) -> str:
    return f"""CASE WHEN {at} >= 0 AND regexp_matches(substring(context, ({at} + 1)::BIGINT, 1), '\\S')
      THEN len({words(f"substring(context, 1, ({at} + 1)::BIGINT)")}) - 1 END"""


def encoded(source: str, room: int, first: str = "question", second: str = "context") -> str:
    return f"""
sides AS (SELECT *, {words(first)} AS a, {words(second)} AS b FROM {source}),
cuts AS (SELECT *, least(len(a), greatest({room} - len(b), ({room} + 1) // 2)) AS ka FROM sides),
enc AS (SELECT *, least(len(b), {room} - ka) AS kb FROM cuts)"""


def placed(room: int) -> str:
    """Token positions with the question first; the separator follows it."""
    return f"""
placed AS (SELECT *, {token_at('s')} + ka + 3 AS st, {token_at('e - 1')} + ka + 3 AS en FROM enc)"""


LABELLED = (
    "WITH " + NOISY + "," + aligned("noisy") + "," + encoded("al", 508) + "," + placed(508)
    + ",\nlab AS (SELECT *, CASE WHEN st IS NOT NULL AND en IS NOT NULL THEN st END AS ps, CASE WHEN st IS NOT NULL AND en IS NOT NULL THEN en END AS pe FROM placed)"
)
LABELLED_128 = LABELLED.replace("508", "124").replace("(508 + 1)", "(124 + 1)")

CLEAN = (
    "WITH " + QA + "," + aligned("qa") + "," + encoded("al", 508) + "," + placed(508)
    + ",\nfeats AS (SELECT * FROM placed WHERE st IS NOT NULL AND en IS NOT NULL)"
)
INPUT = """array_to_string(list_concat(['<s>'], a[1:ka], ['</s>', '</s>'], b[1:kb], ['</s>'], ['<pad>' for x in range({room} - ka - kb)]), ' ')"""
MASK = """array_to_string(list_concat([1 for x in range(ka + kb + 4)], [0 for x in range({room} - ka - kb)]), ' ')"""
TYPES = """array_to_string(list_concat([0 for x in range(ka + 2)], [1 for x in range(kb + 2)], [0 for x in range({room} - ka - kb)]), ' ')"""

EVALUATED = (
    "WITH " + TRIVIA + f""",
asked AS (SELECT *, list_distinct([x for x in string_split({norm('question')}, ' ') if x <> '']) AS ask, {words('context')} AS w FROM flat),
ctx AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM asked),
hit AS (SELECT ctx.doc_id, pos, tok, list_contains(ask, {norm('tok')}) AS h FROM ctx JOIN asked USING (doc_id)),
pick AS (SELECT doc_id, coalesce(min(CASE WHEN h THEN pos END), 1) AS pos FROM hit GROUP BY doc_id),
ev AS (
  SELECT flat.doc_id, context, question, norm_target, targets, replace(tok, '"', '') AS output
  FROM flat LEFT JOIN pick USING (doc_id) LEFT JOIN hit USING (doc_id, pos)),
res AS (SELECT *, coalesce(list_contains(targets, output), false) OR coalesce(output = norm_target, false) AS match FROM ev)"""
)


def mixed(source: str, name: str, keep: str = "") -> str:
    """Two rounds of 32-bit mixing of the column x."""
    turn = "xor(x, x >> 16) * 73244475 % 4294967296 AS x"
    cols = f"block_id, id, i, {keep}"
    return f"""{name}1 AS (SELECT {cols} {turn} FROM {source}),
{name}2 AS (SELECT {cols} {turn} FROM {name}1),
{name} AS (SELECT {cols} xor(x, x >> 16) AS x FROM {name}2),"""


def percent(sums: str) -> str:
    return f"round(100.0 * sum(em) / count(*), 6) AS exact_match, round(100.0 * sum(f1) / count(*), 6) AS f1 {sums}"


ORACLE: dict[str, str] = {
    "read_qa": f"WITH {QA} SELECT seq, lang, context, question, answer, answer_start::BIGINT AS answer_start FROM qa",
    "read_qa_configs": f"WITH {QA} SELECT seq, lang, context, question, answer, answer_start::BIGINT AS answer_start FROM qa WHERE lang IN ('de', 'en', 'es', 'fr')",
    "blocks_from_files": f"WITH {BLOCKS} SELECT block_id, array_to_string(ids, ' ') AS ids FROM blocks",
    "row_at": f"WITH {QA} SELECT * FROM (SELECT seq, lang, answer, row_number() OVER (ORDER BY seq) - 1 AS idx FROM qa) WHERE idx = 333",
    "extract_span_pieces": r"""
WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r])', '\1' || chr(1), 'g'), chr(1)) AS g FROM documents),
n AS (SELECT *, len(g) - 1 AS n, (doc_id * 7) % (len(g) - 1) AS a FROM p WHERE len(g) > 1),
b AS (SELECT *, a + CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 9 END AS b0 FROM n),
c AS (SELECT *, greatest(least(b0, n - 1), 0) AS b FROM b),
e AS (SELECT *, list_sum(list_transform(g[:a + 1], lambda x: len(x))) AS first_end, list_sum(list_transform(g[:b + 1], lambda x: len(x))) AS last_end,
  len(regexp_replace(g[a + 1], '^[ \t\n\r]+', '')) AS first_size FROM c)
SELECT doc_id, CASE WHEN b < a THEN '' ELSE substring(text, (first_end - first_size + 1)::BIGINT, (last_end - first_end + first_size)::BIGINT) END AS answer FROM e""",
    "read_squad_json": f"WITH {QA} SELECT context, question, answer AS text, answer_start::BIGINT AS answer_start FROM qa",
    "read_squad_json_whole": f"WITH {QA} SELECT context, question, answer AS text, answer_start::BIGINT AS answer_start FROM qa",
    "read_text_corpus": """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS seq, line || chr(10) AS line FROM lines""",
    "split_percent": """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
WHERE idx < floor(n * 5 / 100.0 + 0.5)""",
    "materialize_features": CLEAN + f"""
SELECT seq, lang, {INPUT.format(room=508)} AS input_ids, {MASK.format(room=508)} AS attention_mask,
  st::BIGINT AS start_positions, en::BIGINT AS end_positions FROM feats""",
    "metrics_report": f"WITH {SCORED}, m AS (SELECT {percent('')} FROM best) SELECT 'exact_match' AS metric, exact_match AS value FROM m UNION ALL SELECT 'f1', f1 FROM m",
    "format_trivia": f"WITH {TRIVIA} SELECT doc_id, question, context, array_to_string(targets, ' ') AS targets, norm_target FROM flat",
    "filter_nonempty": f"WITH {TRIVIA} SELECT doc_id, len(context) AS n_chars FROM flat WHERE len(context) > 0",
    "filter_length_budget": f"WITH {TRIVIA} SELECT doc_id, question FROM flat WHERE len(question) + len(context) < 16384",
    "filter_valid_spans": LABELLED + " SELECT seq, lang, ps::BIGINT AS start_positions, pe::BIGINT AS end_positions FROM lab WHERE ps IS NOT NULL AND pe IS NOT NULL",
    "feature_view": CLEAN + f"""
SELECT seq, {INPUT.format(room=508)} AS input_ids, {MASK.format(room=508)} AS attention_mask,
  st::BIGINT AS start_positions, en::BIGINT AS end_positions FROM feats""",
    "wrong_answers": EVALUATED + " SELECT doc_id, output, norm_target, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM res WHERE NOT match",
    "head_rows": "SELECT doc_id, substring(text, 1, 333) AS opening FROM documents ORDER BY doc_id LIMIT 3",
    "row_index": f"WITH {QA} SELECT seq, lang, answer, row_number() OVER (ORDER BY seq) - 1 AS idx FROM qa",
    "dedup_runs": f"WITH {KEPT} SELECT lang, seq, idx, context FROM kept",
    "span_groups": f"WITH {QA}, n AS (SELECT seq, row_number() OVER (PARTITION BY lang ORDER BY seq) - 1 AS idx FROM qa) SELECT seq, idx, idx // 3 * 3 AS low, idx // 3 * 3 + 3 AS high FROM n",
    "concat_contexts": f"""
WITH {KEPT}, g AS (
  SELECT lang, idx // 3 AS group_id, string_agg(context, '' ORDER BY idx) AS joined FROM kept GROUP BY ALL)
SELECT k.lang, seq, idx, idx // 3 AS group_id, joined AS context, question, answer,
  (coalesce(sum(len(k.context)) OVER (PARTITION BY k.lang, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + answer_start)::BIGINT AS answer_start
FROM kept k JOIN g ON k.lang = g.lang AND k.idx // 3 = g.group_id""",
    "rebase_answer_start": f"""
WITH {KEPT} SELECT lang, seq, idx,
  (coalesce(sum(len(context)) OVER (PARTITION BY lang, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + answer_start)::BIGINT AS new_start FROM kept""",
    "join_group_context": f"WITH {KEPT} SELECT lang, idx // 3 AS group_id, count(*) AS n_rows, string_agg(context, '' ORDER BY idx) AS context FROM kept GROUP BY ALL",
    "pack_blocks": """
WITH tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
num AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM tok)
SELECT g // 126 AS block_id, count(*) AS n_tokens, string_agg(tok, ' ' ORDER BY g) AS tokens FROM num GROUP BY 1 HAVING count(*) = 126""",
    "shuffle_seeded": f"WITH {QA} SELECT seq, lang, row_number() OVER (ORDER BY ('0x' || substring(md5('42:' || seq), 1, 15))::BIGINT, seq) - 1 AS pos FROM qa",
    "make_batches": f"""
WITH {QA}, n AS (SELECT seq, answer_start, (row_number() OVER (ORDER BY seq) - 1) // 16 AS batch_id FROM qa)
SELECT batch_id, count(*) AS n_rows, string_agg(seq::VARCHAR, ' ' ORDER BY seq) AS seq, string_agg(answer_start::VARCHAR, ' ' ORDER BY seq) AS answer_start FROM n GROUP BY 1""",
    "normalize_answer": f"SELECT doc_id, {norm('text')} AS normal FROM documents",
    "answer_tokens": f"""
WITH t AS (SELECT doc_id, [x for x in string_split({norm('text')}, ' ') if x <> ''] AS w FROM documents)
SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS words FROM t""",
    "token_f1": f"""
WITH pairs AS (
  SELECT a.conv_id, a.turn, {norm('a.text')} AS p, {norm('b.text')} AS g
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'),
pt AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(string_split(p, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
gt AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(string_split(g, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
pn AS (SELECT conv_id, turn, sum(c) AS n FROM pt GROUP BY ALL),
gn AS (SELECT conv_id, turn, sum(c) AS n FROM gt GROUP BY ALL),
sh AS (SELECT conv_id, turn, sum(least(pt.c, gt.c)) AS s FROM pt JOIN gt USING (conv_id, turn, t) GROUP BY ALL)
SELECT conv_id, turn, coalesce(pn.n, 0)::BIGINT AS n_pred, coalesce(gn.n, 0)::BIGINT AS n_gold, coalesce(s, 0)::BIGINT AS shared,
  CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE round(2 * (s::DOUBLE/pn.n) * (s::DOUBLE/gn.n) / ((s::DOUBLE/pn.n) + (s::DOUBLE/gn.n)), 6) END AS f1
FROM pairs LEFT JOIN pn USING (conv_id, turn) LEFT JOIN gn USING (conv_id, turn) LEFT JOIN sh USING (conv_id, turn)""",
    "exact_match": f"WITH {PREDICTIONS} SELECT seq, {norm('pred')} = {norm('golds[1]')} AS em FROM predictions",
    "best_over_golds": f"WITH {SCORED} SELECT seq, em::BIGINT AS em, round(f1, 6) AS f1 FROM best",
    "align_answer": f'WITH {NOISY}, {aligned("noisy")} SELECT seq, s::BIGINT AS start, e::BIGINT AS "end" FROM al',
    "align_answer_ci": f"""WITH {NOISY}, low AS (SELECT seq, context, lower(answer) AS answer, answer_start FROM noisy), {aligned("low", True)}
SELECT seq, s::BIGINT AS start, e::BIGINT AS "end" FROM al""",
    "tokenize_offsets": """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text FROM documents),
p AS (SELECT doc_id, regexp_extract_all(text, '\\S+|\\s+') AS w FROM s),
r AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM p),
o AS (SELECT doc_id, tok, i, sum(len(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r),
a AS (SELECT doc_id, count(*) AS n_tokens, string_agg(tok, ' ' ORDER BY i) AS tok,
  string_agg((e - len(tok))::BIGINT::VARCHAR, ' ' ORDER BY i) AS starts, string_agg(e::BIGINT::VARCHAR, ' ' ORDER BY i) AS ends
FROM o WHERE regexp_matches(tok, '\\S') GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n_tokens, 0) END AS n_tokens, CASE WHEN text IS NOT NULL THEN coalesce(tok, '') END AS tok,
  CASE WHEN text IS NOT NULL THEN coalesce(starts, '') END AS starts, CASE WHEN text IS NOT NULL THEN coalesce(ends, '') END AS ends FROM s LEFT JOIN a USING (doc_id)""",
    "encode_pair": f"WITH {QA}, {encoded('qa', 124)} SELECT seq, {INPUT.format(room=124)} AS input, {MASK.format(room=124)} AS attention_mask, {TYPES.format(room=124)} AS token_type_ids, ka::BIGINT AS kept_first, kb::BIGINT AS kept_second FROM enc",
    "encode_pair_context_first": f"WITH {QA}, {encoded('qa', 124, 'context', 'question')} SELECT seq, {INPUT.format(room=124)} AS input FROM enc",
    "span_to_tokens": f'WITH {QA}, {aligned("qa")}, {encoded("al", 124)}, {placed(124)} SELECT seq, st::BIGINT AS start, en::BIGINT AS "end" FROM placed',
    "span_policy": f"""WITH {QA}, {aligned("qa")}, {encoded("al", 124)}, {placed(124)},
r AS (SELECT *, least(len(b), greatest(124 - len(a), 62)) AS kc, {token_at('s')} AS cs, {token_at('e - 1')} AS ce,
  st IS NOT NULL AND en IS NOT NULL AS ok FROM placed)
SELECT seq,
  CASE WHEN ok THEN st END::BIGINT AS null_start, CASE WHEN ok THEN en END::BIGINT AS null_end,
  CASE WHEN ok AND en > 128 THEN 0 WHEN ok THEN st END::BIGINT AS null_zero_start, CASE WHEN ok AND en > 128 THEN 0 WHEN ok THEN en END::BIGINT AS null_zero_end,
  CASE WHEN en > 128 THEN 0 ELSE st END::BIGINT AS zero_start, CASE WHEN en > 128 THEN 0 ELSE en END::BIGINT AS zero_end,
  CASE WHEN cs < kc THEN cs + 1 ELSE 128 END::BIGINT AS fill_max_start, CASE WHEN ce < kc THEN ce + 1 ELSE 128 END::BIGINT AS fill_max_end
FROM r""",
    "build_vocab": f"""WITH {VOCAB}
SELECT token, token_id::BIGINT AS token_id, n FROM voc
UNION ALL SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', 1, 0), ('</s>', 2, 0), ('<unk>', 3, 0), ('<mask>', 4, 0))""",
    "ids_tokens": f"""WITH {IDS}
SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(CASE WHEN id = 3 THEN '<unk>' ELSE tok END, ' ' ORDER BY pos) AS tokens FROM ids GROUP BY doc_id""",
    "vocab_lookup": f"WITH {IDS} SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (id = 3) AS n_unknown, sum(id * (pos + 1))::BIGINT AS checksum FROM ids GROUP BY doc_id",
    "wrap_special": f"WITH {BLOCKS} SELECT block_id, array_to_string(ids, ' ') AS ids FROM blocks",
    "mlm_mask": f"""WITH {BLOCKS},
cells AS (SELECT block_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS i,
  (block_id + 42 * 1000003) % 4294967296 AS x FROM blocks),
{mixed('cells', 'a')}
starts AS (SELECT block_id, id, i, xor(x, i * 2654435761 % 4294967296) AS x FROM a),
{mixed('starts', 'b')}
firsts AS (SELECT block_id, id, i, x AS d1, (x + 2654435761) % 4294967296 AS x FROM b),
{mixed('firsts', 'c', 'd1,')}
seconds AS (SELECT block_id, id, i, d1, x AS d2, x FROM c),
{mixed('seconds', 'd', 'd1, d2,')}
picked AS (SELECT *, d1 < 644245094 AND id NOT IN (0, 2) AS c FROM d),
done AS (SELECT block_id, i, CASE WHEN c THEN id ELSE -100 END AS label,
  CASE WHEN NOT c THEN id WHEN d2 < 3435973836 THEN 4 WHEN d2 < 3865470566 THEN x % (SELECT count(*) + 5 FROM voc) ELSE id END AS input FROM picked)
SELECT block_id, string_agg(input::VARCHAR, ' ' ORDER BY i) AS input_ids, string_agg(label::VARCHAR, ' ' ORDER BY i) AS labels,
  count(*) FILTER (label <> -100) AS n_chosen FROM done GROUP BY block_id""",
    "extract_span": """
WITH v AS (SELECT vec_id, embedding AS s, list_reverse(embedding) AS e FROM embeddings),
m AS (SELECT vec_id, list_position(s, list_max(s)) - 1 AS st, list_position(e, list_max(e)) - 1 AS en FROM v)
SELECT vec_id, st::BIGINT AS start, en::BIGINT AS "end", array_to_string(['t' || x for x in range(st, en + 1)], ' ') AS answer FROM m""",
    "clean_output": "SELECT doc_id, replace(text, '\"', '') AS output FROM documents",
    "alias_match": f"""WITH {TRIVIA}, g AS (SELECT *, string_split(context, ' ')[1] AS guess FROM flat)
SELECT doc_id, coalesce(list_contains(targets, guess), false) OR coalesce(guess = norm_target, false) AS match FROM g""",
    "align_predictions": f"""WITH {PREDICTIONS}, p AS (SELECT seq + 1 AS seq, pred FROM predictions)
SELECT seq, answer, pred, CASE WHEN p.seq IS NULL THEN 'no prediction' WHEN qa.seq IS NULL THEN 'no reference' ELSE 'paired' END AS state
FROM qa FULL JOIN p USING (seq)""",
    "label_languages": """
SELECT lang, count(*) AS n, CASE lang WHEN 'de' THEN 'XQuAD German validation' WHEN 'en' THEN 'XQuAD English validation' WHEN 'es' THEN 'XQuAD Spanish validation' END AS label FROM documents GROUP BY lang""",
    "squad_eval": f"WITH {SCORED} SELECT {percent(', count(*) AS n, 0::BIGINT AS n_unscored')} FROM best",
    "squad_eval_by_lang": f"WITH {SCORED} SELECT lang, {percent(', count(*) AS n, 0::BIGINT AS n_unscored')} FROM best GROUP BY lang UNION ALL SELECT 'all', {percent(', count(*), 0')} FROM best",
    "alias_accuracy": EVALUATED + " SELECT count(*) FILTER (match) AS n_correct, count(*) AS n_total FROM res WHERE len(context) > 0",
    "binary_metrics": """
WITH c AS (
  SELECT count(*) FILTER (n_chars >= 500 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 500 AND quality <> 1) AS fp,
    count(*) FILTER (n_chars < 500 AND quality = 1) AS fn, count(*) FILTER (n_chars < 500 AND quality <> 1) AS tn
  FROM labels JOIN documents USING (doc_id))
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
  round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""",
    "bits_per_token": """
WITH tok AS (SELECT unnest(string_split(text, ' ')) AS tok FROM documents),
c AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok),
l AS (SELECT n, -ln(n / (SELECT sum(n) FROM c)::DOUBLE) AS loss FROM c)
SELECT round(sum(loss * n) / sum(n), 6) AS loss, round(sum(loss * n) / sum(n) / ln(2), 6) AS bits FROM l""",
    "span_stats": LABELLED + " SELECT max(ps)::BIGINT AS max_start, count(*) AS n_rows FROM lab WHERE ps IS NOT NULL AND pe IS NOT NULL",
    "length_profile": f"""
WITH n AS (SELECT lang, len({words('text')}) AS l FROM documents)
SELECT lang, count(*) AS n_rows, round(avg(l), 6) AS mean_length, round(quantile_cont(l::DOUBLE, 0.5), 6) AS median_length, max(l) AS max_length,
  count(*) FILTER (l <= 512) AS fit_512, count(*) FILTER (l <= 1024) AS fit_1024, count(*) FILTER (l <= 2048) AS fit_2048, count(*) FILTER (l <= 4096) AS fit_4096
FROM n GROUP BY lang""",
    "row_lengths": f"WITH {QA} SELECT seq, len(question) AS question_length, len(context) AS context_length FROM qa",
    "concat_fit": f"""
WITH {KEPT}, s AS (SELECT lang, idx, len({words('context')}) AS n, unnest([1, 3, 5]) AS span FROM kept),
g AS (SELECT lang, span, idx // span AS g, sum(n) AS l FROM s GROUP BY ALL)
SELECT lang, span::BIGINT AS span, count(*) AS n_groups, max(l)::BIGINT AS max_tokens,
  count(*) FILTER (l <= 512) AS fit_512, count(*) FILTER (l <= 1024) AS fit_1024, count(*) FILTER (l <= 2048) AS fit_2048, count(*) FILTER (l <= 4096) AS fit_4096
FROM g GROUP BY ALL""",
    "row_audit": LABELLED_128 + """
SELECT lang, CASE WHEN s IS NULL THEN 'unaligned' WHEN ps IS NULL OR pe IS NULL THEN 'unmapped' WHEN pe >= 128 THEN 'over_long' ELSE 'kept' END AS reason, count(*) AS n_rows
FROM lab GROUP BY ALL""",
    "union_languages": f"WITH {QA} SELECT seq, doc_id, lang, context AS text FROM qa",
    "map_rows": "SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents",
    "filter_rows": "SELECT doc_id, lang FROM documents WHERE contains(text, chr(10))",
    "score_spans": f"""
WITH {QA}, asked AS (SELECT seq, context, string_split({norm('question')}, ' ') AS ask FROM qa),
w AS (SELECT seq, ask, unnest({words('context')}) AS tok, generate_subscripts({words('context')}, 1) AS pos FROM asked)
SELECT seq, string_agg(CASE WHEN {norm('tok')} <> '' AND list_contains(ask, {norm('tok')}) THEN '1' ELSE '0' END, ' ' ORDER BY pos) AS start_scores FROM w GROUP BY seq""",
    "score_spans_model": """
WITH v AS (SELECT vec_id, embedding AS s, list_reverse(embedding) AS e FROM embeddings),
m AS (SELECT vec_id, list_position(s, list_max(s)) - 1 AS st, list_position(e, list_max(e)) - 1 AS en FROM v)
SELECT vec_id, array_to_string(range(st, en + 1), ' ') AS answer FROM m""",
    "distributed_eval": EVALUATED + " SELECT doc_id, output, match FROM res",
}

_AUDIT_LONG = """
SELECT lang, CASE WHEN s IS NULL THEN 'unaligned' WHEN st IS NULL OR en IS NULL THEN 'unmapped' WHEN en >= 512 THEN 'over_long' ELSE 'kept' END AS reason, count(*) AS n_rows
FROM placed GROUP BY ALL
UNION ALL SELECT lang, 'repeated', count(*) - (SELECT count(*) FROM kept k WHERE k.lang = qa.lang) FROM qa GROUP BY lang"""

_LONG = (
    "WITH " + KEPT + """,
g AS (SELECT lang, idx // 3 AS gi, string_agg(context, '' ORDER BY idx) AS joined FROM kept GROUP BY ALL),
long AS (
  SELECT seq, k.lang, question, answer, joined AS context,
    (coalesce(sum(len(k.context)) OVER (PARTITION BY k.lang, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + answer_start)::BIGINT AS answer_start
  FROM kept k JOIN g ON k.lang = g.lang AND k.idx // 3 = g.gi),""" + aligned("long") + "," + encoded("al", 2044) + "," + placed(2044)
)
ORACLE["audit_preparation"] = _LONG.replace("2044", "508") + _AUDIT_LONG
ORACLE["prepare_long_features"] = _LONG + """
SELECT seq, lang, st::BIGINT AS start_positions, en::BIGINT AS end_positions, (ka + kb + 4)::BIGINT AS n_used FROM placed
WHERE st IS NOT NULL AND en IS NOT NULL"""

ORACLE["label_long_spans"] = _LONG + """
SELECT seq,
  CASE WHEN st IS NULL OR en IS NULL THEN NULL WHEN en > 2048 THEN 0 ELSE st END::BIGINT AS null_zero_start,
  CASE WHEN st IS NULL OR en IS NULL THEN NULL WHEN en > 2048 THEN 0 ELSE en END::BIGINT AS null_zero_end,
  coalesce(st, 2048)::BIGINT AS fill_max_start, coalesce(en, 2048)::BIGINT AS fill_max_end FROM placed"""
ORACLE["trivia_training_batches"] = f"""
WITH {NOISY}, low AS (SELECT seq, question, context, lower(answer) AS answer, answer_start FROM noisy),
{aligned("low", True)}, {encoded("al", 252, "context", "question")},
lab AS (SELECT *, {token_at('s')} AS cs, {token_at('e - 1')} AS ce FROM enc),
pos AS (SELECT seq, CASE WHEN cs < ka THEN cs + 1 ELSE 256 END AS st, CASE WHEN ce < ka THEN ce + 1 ELSE 256 END AS en, {INPUT.format(room=252)} AS input,
  row_number() OVER (ORDER BY ('0x' || substring(md5('42:' || seq), 1, 15))::BIGINT, seq) - 1 AS i FROM lab)
SELECT i // 16 AS batch_id, count(*) AS n_rows, string_agg(seq::VARCHAR, ' ' ORDER BY i) AS seq, string_agg(st::BIGINT::VARCHAR, ' ' ORDER BY i) AS start_positions,
  string_agg(en::BIGINT::VARCHAR, ' ' ORDER BY i) AS end_positions, string_agg(input, ' ' ORDER BY i) AS input_ids FROM pos GROUP BY 1"""
ORACLE["trivia_training_batches_custom"] = ORACLE["trivia_training_batches"]
_MODEL = "WITH " + SCORED.replace(PREDICTIONS, QA + f""",
asked AS (SELECT seq, [x for x in string_split({norm('question')}, ' ') if x <> ''] AS ask, {words('context')} AS w FROM qa),
ctx AS (SELECT seq, unnest(w) AS tok, generate_subscripts(w, 1) AS p_, ask FROM asked),
hit AS (SELECT seq, p_, tok, list_contains(ask, {norm('tok')}) AS h FROM ctx),
pick AS (SELECT seq, coalesce(min(CASE WHEN h THEN p_ END), 1) AS p_ FROM hit GROUP BY seq),
predictions AS (SELECT seq, lang, golds, coalesce(tok, '') AS pred FROM qa LEFT JOIN pick USING (seq) LEFT JOIN hit USING (seq, p_))""")
ORACLE["evaluate_model_report"] = (
    _MODEL
    + """, m AS (SELECT lang, 100.0 * avg(em) AS em, 100.0 * avg(f1) AS f1 FROM best GROUP BY lang UNION ALL SELECT 'all', 100.0 * avg(em), 100.0 * avg(f1) FROM best)
SELECT lang || '_exact_match' AS metric, round(em, 6) AS value FROM m UNION ALL SELECT lang || '_f1', round(f1, 6) FROM m"""
)
ORACLE["evaluate_model_datasets"] = _MODEL + """,
d AS (SELECT CASE WHEN seq // 4 % 3 = 0 THEN 'mlqa' ELSE 'xquad' END AS dataset, lang, em, f1 FROM best),
m AS (SELECT coalesce(dataset, 'all') AS dataset, coalesce(lang, 'all') AS lang, 100.0 * avg(em) AS em, 100.0 * avg(f1) AS f1, count(*) AS n
  FROM d GROUP BY GROUPING SETS ((dataset, lang), (dataset), ())),
names AS (SELECT * FROM (VALUES ('de', 'German'), ('en', 'English'), ('es', 'Spanish')) v(lang, name), (VALUES ('xquad', 'XQuAD'), ('mlqa', 'MLQA')) t(dataset, title))
SELECT dataset, lang, title || ' ' || name || ' validation' AS label, round(em, 6) AS exact_match, round(f1, 6) AS f1, n FROM m LEFT JOIN names USING (dataset, lang)"""
ORACLE["count_over_budget"] = f"WITH {TRIVIA} SELECT count(*) AS n_total, count(*) FILTER (len(question) + len(context) >= 16384) AS n_over FROM flat"
ORACLE["row_index_text"] = f"WITH {QA} SELECT 'q' || seq AS id, lang, row_number() OVER (ORDER BY 'q' || seq) - 1 AS idx FROM qa"
ORACLE["pack_blocks_long"] = """
WITH tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
num AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM tok)
SELECT g // 4094 AS block_id, count(*) AS n_tokens, md5(string_agg(tok, ' ' ORDER BY g)) AS md5 FROM num GROUP BY 1 HAVING count(*) = 4094"""
ORACLE["make_batches_large"] = ORACLE["make_batches"].replace("// 16", "// 2000")
ORACLE["ids_tokens_joined"] = ORACLE["ids_tokens"]
ORACLE["vocab_lookup_salted"] = ORACLE["vocab_lookup"]

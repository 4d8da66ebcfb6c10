"""SQL of the queries in ``reference``."""

from __future__ import annotations

from sievework.plans.evaluation import similarity_sql, trim_sql

# ---- rubric -----------------------------------------------------------------


def _name(x: str) -> str:
    text = rf"regexp_replace(lower(coalesce({x}, '')), '\([^)]*\)|\[[^\]]*\]', '', 'g')"
    text = rf"regexp_replace({text}, '\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b', '', 'g')"
    text = rf"regexp_replace({text}, '\d+(?:\.\d+)?\s*(?:㎎|㎍|㎖|밀리그램|마이크로그램|그램|밀리리터)', '', 'g')"
    return f"regexp_replace({text}, '[^0-9a-z가-힣]', '', 'g')"


def _code(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^0-9A-Z가-힣]', '', 'g')"


def _category(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z가-힣]', '', 'g')"


def _imprint(x: str) -> str:
    t = trim_sql(x)
    return (
        f"(case when regexp_matches({t}, '^(?:없음|무각인|빈면|blank|none|[-—–])$', 'i') then '∅' "
        f"when regexp_matches({t}, '^(?:확인불가|판독불가|식별불가|unreadable|unknown)$', 'i') then '?' "
        f"else regexp_replace(upper({t}), '[^0-9A-Z가-힣]', '', 'g') end)"
    )


def _likeness(a: str, b: str) -> str:
    return (
        f"(case when {a} = '' then null when {b} = '' then 0.0 when {a} = {b} then 1.0 "
        f"when least(length({a}), length({b})) >= 2 and (contains({a}, {b}) or contains({b}, {a})) then 0.75 "
        f"when {similarity_sql(a, b)} >= 0.75 then {similarity_sql(a, b)} else 0.0 end)"
    )


def _mean(a: str, b: str) -> str:
    return f"(case when {a} is null then {b} when {b} is null then {a} else ({a} + {b}) / 2 end)"


RUBRIC_SQL = rf"""
WITH t AS (SELECT *, coalesce(nullif(condition.variant, ''), 'original') AS v FROM gt_record WHERE sample_id IS NOT NULL),
te AS (SELECT sample_id, v, arg_max({{'a': answer, 'c': condition}}, gt_id) AS t FROM t GROUP BY 1, 2),
ta AS (SELECT sample_id, arg_min({{'a': answer, 'c': condition}}, gt_id) AS t FROM t GROUP BY 1),
b AS (
    SELECT r.result_id, run_id, r.sample_id, provider, model, coalesce(error, '') AS error, prediction AS p, coalesce(te.t, ta.t) AS t
    FROM research_result r LEFT JOIN te ON te.sample_id = r.sample_id AND te.v = coalesce(nullif(r.meta['variant'], ''), 'original')
    LEFT JOIN ta ON ta.sample_id = r.sample_id
),
n AS (
    SELECT *, {_name("t.a.drug_name")} AS tn, {_code("t.a.mfds_item_id")} AS tc, {_name("p.drug_name")} AS pn, {_code("p.drug_code")} AS pc,
        {trim_sql("t.a.front_imprint")} <> '' AS kf, {trim_sql("t.a.back_imprint")} <> '' AS kb,
        {_imprint("t.a.front_imprint")} AS tf, {_imprint("t.a.back_imprint")} AS tb, {_imprint("p.front_imprint")} AS pf, {_imprint("p.back_imprint")} AS pb,
        {_category("t.a.shape")} AS ts, {_category("t.a.color")} AS tcol, {_category("p.shape")} AS ps, {_category("p.color")} AS pcol,
        {_category("p.front_imprint")} AS cf, {_category("p.back_imprint")} AS cb, {trim_sql("p.evidence")} AS evidence, {_category("p.evidence")} AS ce, {trim_sql("p.uncertainty")} AS uncertainty,
        case when p.confidence > 1 and p.confidence <= 100 then p.confidence / 100 else least(1.0, greatest(0.0, p.confidence)) end AS cc, p.confidence AS raw,
        coalesce(t.c.expected_readable, true) AS readable
    FROM b
),
s AS (
    SELECT *, case when raw is null then null else cc end AS confidence, (tn <> '' or tc <> '') and error = '' AS ready,
        case when tn <> '' and pn <> '' then {similarity_sql("tn", "pn")} else 0.0 end AS similarity,
        (tc <> '' and tc = pc) or (tn <> '' and tn = pn) AS exact, pn <> '' or pc <> '' AS named,
        pn = '' and pc = '' and regexp_matches(concat_ws(' ', uncertainty, evidence), '판독\s*불가|식별\s*불가|확인\s*불가|근거\s*부족|불확실|unreadable|unknown|cannot\s+(?:read|identify)|insufficient', 'i') AS abstains,
        case when kf then {similarity_sql("tf", "pf")} end AS ff, case when kb then {similarity_sql("tb", "pb")} end AS bb,
        case when kf then {similarity_sql("tf", "pb")} end AS fb, case when kb then {similarity_sql("tb", "pf")} end AS bf,
        {_likeness("ts", "ps")} AS shape_similarity, {_likeness("tcol", "pcol")} AS color_similarity
    FROM n
),
v AS (
    SELECT *, {_mean("ff", "bb")} AS direct, {_mean("fb", "bf")} AS swapped, {_mean("shape_similarity", "color_similarity")} AS appearance,
        case when exact then 'correct'
            when tn <> '' and pn <> '' and ((least(length(tn), length(pn)) >= 4 and (contains(tn, pn) or contains(pn, tn))) or similarity >= 0.82) then 'partial'
            when not readable and abstains then 'correct' else 'wrong' end AS verdict,
        uncertainty <> '' and not regexp_matches(uncertainty, '^(?:없음|없다|none|no|확실|확정)$', 'i') AS honest, coalesce(confidence >= 0.85, false) AS sure
    FROM s
),
w AS (
    SELECT *, coalesce(greatest(direct, swapped), 0) AS ratio,
        (case when evidence = '' then 0.0
            when (length(cf) >= 2 and contains(ce, cf)) or (length(cb) >= 2 and contains(ce, cb)) or (length(ps) >= 2 and contains(ce, ps)) or (length(pcol) >= 2 and contains(ce, pcol))
                or regexp_matches(evidence, '각인|모양|형태|색|분할|식약처|mfds|품목|등록|사진|관찰|대조|일치', 'i') then 1.0
            when length(evidence) >= 12 then 0.6 else 0.3 end) * case when verdict = 'wrong' and pn <> '' then 0.25 else 1.0 end AS stated
    FROM v
),
rc AS (
    SELECT result_id, run_id, sample_id, provider, model, ready,
        case when ready then verdict end AS verdict,
        case when ready then case verdict when 'correct' then 40.0 when 'partial' then 20.0 else 0.0 end end AS accuracy,
        case when ready then floor((((8 * case verdict when 'correct' then 1.0 when 'partial' then 0.5 else 0.0 end
            + case when kf or kb then 7 * ratio else 0 end + case when appearance is not null then 4 * appearance else 0 end + 3 * stated)
            / (11 + case when kf or kb then 7 else 0 end + case when appearance is not null then 4 else 0 end) * 25) + 2.220446049250313e-16) * 10 + 0.5) / 10 end AS evidence,
        case when ready then least(20.0, greatest(0.0,
            case when verdict = 'correct' or (not named and honest) then 20.0 when not named then 15.0 when verdict = 'partial' then 14.0 else 6.0 end
            - case when verdict = 'wrong' and named and sure then 4 when verdict = 'partial' and named and sure then 3 else 0 end
            - case when verdict <> 'correct' and named and not honest then 2 else 0 end
            - case when verdict <> 'correct' and regexp_matches(regexp_replace(concat_ws(' ', evidence, uncertainty), '불확실(?:성)?', '', 'g'), '확정|확실|틀림없|명백|100\s*%|단정', 'i') then 2 else 0 end
            - case when named and sure and (kf or kb) and ratio < 0.25 then 2 else 0 end)) end AS hallucination,
        case when ready then floor(((case when named or abstains then 4 else 0 end + case when {trim_sql("p.front_imprint")} <> '' then 2 else 0 end + case when {trim_sql("p.back_imprint")} <> '' then 2 else 0 end
            + case when {trim_sql("p.shape")} <> '' then 1 else 0 end + case when {trim_sql("p.color")} <> '' then 1 else 0 end + case when confidence is not null then 2 else 0 end
            + case when evidence <> '' then 1.5 else 0 end + case when uncertainty <> '' then 1.5 else 0 end)::double + 2.220446049250313e-16) * 10 + 0.5) / 10 end AS clarity,
        case when ready then round(similarity, 4) end AS name_similarity, case when ready then round(greatest(direct, swapped), 4) end AS imprint_similarity,
        case when ready then case when swapped > direct then 'swapped' else 'direct' end end AS orientation, case when ready then round(appearance, 4) end AS appearance_similarity
    FROM w
),
one AS (SELECT run_id, provider, model, count(*) AS n_cases, bool_and(ready) AS ready, avg(accuracy) AS a, avg(evidence) AS e, avg(hallucination) AS h, avg(clarity) AS c FROM rc GROUP BY ALL),
ten AS (SELECT run_id, provider, model, n_cases, ready, """ + ", ".join(
    f"case when ready then floor(({x} + 2.220446049250313e-16) * 10 + 0.5) / 10 end AS {name}" for x, name in (("a", "accuracy"), ("e", "evidence"), ("h", "hallucination"), ("c", "clarity"))
) + """ FROM one),
bt AS (SELECT *, floor((accuracy + evidence + hallucination + clarity + 2.220446049250313e-16) * 10 + 0.5) / 10 AS total FROM ten),
ranked AS (SELECT run_id, provider || ':' || model AS label, total, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, provider || ':' || model) AS k FROM bt WHERE total IS NOT NULL),
win AS (
    SELECT n.run_id, n.n_ranked, case when n.n_ranked < 2 then '' when a.total - b.total <= 1 then 'tie' else a.label end AS vote,
        case when n.n_ranked >= 2 then floor((a.total - b.total + 2.220446049250313e-16) * 10 + 0.5) / 10 end AS difference
    FROM (SELECT run_id, count(total) AS n_ranked FROM bt GROUP BY 1) n LEFT JOIN ranked a ON a.run_id = n.run_id AND a.k = 1 LEFT JOIN ranked b ON b.run_id = n.run_id AND b.k = 2
)
"""

# ---- sheets -----------------------------------------------------------------


def _key(x: str) -> str:
    return f"lower(string_split(replace({trim_sql(x)}, '\\', '/'), '/')[-1])"


_IMAGES = f"""im AS (SELECT unnest([front_image, back_image]) AS image FROM answer_sheet WHERE drug_name IS NOT NULL),
files AS (SELECT {_key("image")} AS image_key, count(*) AS n_files FROM im WHERE {_key("image")} <> '' GROUP BY 1)"""

_VALIDATION = f"""WITH {_IMAGES},
r AS (SELECT row_id, {", ".join(f"{trim_sql(c)} AS {c}" for c in ("case_id", "front_image", "back_image", "mfds_item_id", "drug_name", "front_imprint", "back_imprint"))},
    lower({trim_sql("case_id")}) AS ck, {_key("front_image")} AS f, {_key("back_image")} AS b FROM answer_sheet),
u AS (SELECT ck, count(*) AS uses FROM r WHERE ck <> '' GROUP BY 1),
j AS (SELECT r.*, coalesce(u.uses, 0) AS uses, coalesce(x.n_files, 0) AS fn, coalesce(y.n_files, 0) AS bn FROM r LEFT JOIN u USING (ck) LEFT JOIN files x ON x.image_key = f LEFT JOIN files y ON y.image_key = b),
e AS (SELECT row_id, concat_ws('|', case when case_id = '' then 'missing_case_id' end, case when front_image = '' then 'missing_front_image' end, case when back_image = '' then 'missing_back_image' end,
    case when mfds_item_id = '' and drug_name = '' then 'missing_answer' end, case when uses > 1 then 'duplicate_case_id' end,
    case when f <> '' and fn = 0 then 'front_image_not_found' end, case when fn > 1 then 'front_image_ambiguous' end,
    case when b <> '' and bn = 0 then 'back_image_not_found' end, case when bn > 1 then 'back_image_ambiguous' end, case when f <> '' and f = b then 'same_image' end) AS errors,
    case when front_imprint = '' and back_imprint = '' then 'no_imprint' else '' end AS warnings FROM j)
SELECT *, errors = '' AS valid FROM e"""


def _variant(field: str, normal: str) -> str:
    value = f"lower({trim_sql(field)})"
    return f"when {value} <> '' and not regexp_matches({value}, '^(?:{normal})$') then '{field}:' || {value}"


_NUMBERS = " , ".join(
    f"case when {c} < 0 or isnan({c}) or isinf({c}) then '{c}' end" for c in ("usage.input_tokens", "usage.output_tokens", "usage.cached_tokens", "usage.cost_usd", "latency_ms")
)

# ---- redaction --------------------------------------------------------------

_KINDS = "['주민등록번호', '전화번호', '이메일', '개인식별번호', '성명']"
_CONDITIONS = "['clean', 'blur', 'tilt', 'dark', 'glare', 'handwriting', 'fold', 'unknown']"
DOCS_SQL = f"""WITH d AS (SELECT doc_id, {_CONDITIONS}[(doc_id % 8 + 1)::int] AS condition, n_chars FROM documents),
it AS (SELECT doc_id, k AS item_no, {_KINDS}[k + 1] AS type, 100 AS x0, 100 + k * 200 AS y0, 300 AS x1, 140 + k * 200 AS y1, (doc_id + k * 3 + n_chars) % 5 AS way FROM d, range(5) r(k) WHERE n_chars > 60),
bx AS (
    SELECT doc_id, item_no, unnest(case way when 0 then [[90, 90, 310, 150]] when 1 then [[100, 100, 210, 140], [190, 95, 320, 145]] when 2 then [[290, 120, 500, 160]] when 3 then [[600, 100, 700, 150]] else [] end) AS b
    FROM it
),
bb AS (SELECT doc_id, item_no, b[1] AS x0, b[2] + item_no * 200 AS y0, b[3] AS x1, b[4] + item_no * 200 AS y1 FROM bx),
px AS (SELECT i.doc_id, i.item_no, i.type, count(DISTINCT x * 10000 + y) AS hit
    FROM it i, range(100, 300, 10) c(x), range(0, 40, 5) e(dy), LATERAL (SELECT i.y0 + dy AS y), bb
    WHERE bb.doc_id = i.doc_id AND bb.x0 <= x AND bb.x1 >= x + 10 AND bb.y0 <= y AND bb.y1 >= y + 5 GROUP BY ALL),
sc AS (SELECT it.*, coalesce(hit, 0) / 160 >= 0.9 AS covered FROM it LEFT JOIN px USING (doc_id, item_no)),
pi AS (SELECT doc_id, count(*) AS items, count(*) filter (covered) AS covered, count(*) * 8000 AS items_area FROM sc GROUP BY 1),
pb AS (SELECT doc_id, count(*) AS boxes, count(*) filter (NOT t) AS stray_boxes, sum((x1 - x0) * (y1 - y0)) AS redacted_area, coalesce(sum((x1 - x0) * (y1 - y0)) filter (NOT t), 0) AS stray_area
    FROM (SELECT bb.*, EXISTS (SELECT 1 FROM it WHERE it.doc_id = bb.doc_id AND it.x0 < bb.x1 AND bb.x0 < it.x1 AND it.y0 < bb.y1 AND bb.y0 < it.y1) AS t FROM bb) GROUP BY 1),
ds AS (
    SELECT doc_id, condition, coalesce(items, 0) AS items, coalesce(covered, 0) AS covered, coalesce(items, 0) - coalesce(covered, 0) AS missed, coalesce(items, 0) > 0 AND covered = items AS complete,
        case when items > 0 then round(covered / items, 6) end AS recall, coalesce(boxes, 0) AS boxes, coalesce(stray_boxes, 0) AS stray_boxes, floor(coalesce(stray_area, 0) + 0.5) AS stray_area,
        floor(coalesce(redacted_area, 0) + 0.5) AS redacted_area, case when redacted_area > 0 then floor(stray_area / redacted_area * 1000 + 0.5) / 1000 end AS stray_area_ratio,
        case when items_area > 0 then floor(coalesce(redacted_area, 0) / items_area * 100 + 0.5) / 100 end AS over_redaction, floor(coalesce(redacted_area, 0) / 1400000 * 1000 + 0.5) / 1000 AS page_coverage
    FROM d LEFT JOIN pi USING (doc_id) LEFT JOIN pb USING (doc_id)
)
"""
percent_sql = lambda part, whole: f"case when {whole} > 0 then floor(({part}) / ({whole}) * 1000 + 0.5) / 10 end"

_LOG = f"""WITH l AS (SELECT *, {_CONDITIONS}[(user_id % 8 + 1)::int] AS condition, event_type = 'error' AS bad, event_id % 4 AS au, user_id % 3 AS ma, event_id % 5 % 2 AS er,
    least(1.0, greatest(0.0, value / 100)) AS conf, event_id % 1000 AS ms FROM events),
o AS (SELECT *, case when au + ma = 0 then 'failed' when bad or au = 0 then 'manual_only' when ma > 0 or er > 0 then 'manual_assisted' else 'auto' end AS outcome FROM l)
"""
_IS = lambda o: f"count(*) filter (outcome = '{o}')"

WORDS_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS text, generate_subscripts(regexp_split_to_array(trim(text), '\s+'), 1) - 1 AS word_no FROM documents),
p AS (SELECT doc_id, word_no // 400 AS page, word_no, word_no % 8 * 120 AS x0, word_no % 8 * 120 + 9 * length(text) AS x1, word_no % 400 // 8 AS row_no FROM w)
"""

_COLORS = (
    ("하양", "하양|흰|백색|화이트|아이보리|미백|유백"), ("노랑", "노랑|노란|황색|담황|미황|연노랑|황갈"), ("주황", "주황|오렌지|살구|귤"), ("분홍", "분홍|핑크|연분홍|살색"),
    ("빨강", "빨강|빨간|적색|레드|자적|진홍"), ("갈색", "갈색|브라운|밤색|적갈|황토|커피"), ("파랑", "파랑|파란|청색|블루|하늘"), ("남색", "남색|네이비|짙은파랑|어두운파랑"),
    ("청록", "청록|틸|민트"), ("초록", "초록|녹색|그린|진녹"), ("연두", "연두|연녹|라임|연초록"), ("보라", "보라|자주|퍼플|바이올렛|라벤더"), ("회색", "회색|그레이|은색|회백"), ("검정", "검정|검은|흑색|블랙"), ("투명", "투명|무색"),
)
_COLOR_CASE = "case " + " ".join(f"when regexp_matches(c, '{p}') then '{n}'" for n, p in _COLORS) + " else c end"
colors_sql = lambda x: f"list_reduce(list_transform(list_filter(regexp_split_to_array(coalesce({x}, ''), '[|,/·+\\s]+'), lambda c: c <> ''), lambda c: [{_COLOR_CASE}]), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end, []::varchar[])"
mark_sql = lambda x: f"(case when coalesce({x}, '') in ('', '없음', '확인불가') then '' else upper(regexp_replace(regexp_replace({x}, '분할선|마크|식별', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')) end)"

_CLEAN = "'<p><![CDATA[' || coalesce(\"at\", '') || ']]></p>&nbsp;<br/>' || coalesce(ef, '')"
for _pattern, _new in ((r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1"), (r"(?i)<br\s*/?>|</(?:p|PARAGRAPH|ARTICLE|SECTION)>", "\n"), ("<[^>]+>", "")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_new}', 'g')"
for _entity, _plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _CLEAN = f"replace({_CLEAN}, '{_entity}', '{_plain}')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[ \x{{3000}}\t]+', ' ', 'g'), '\n{{2,}}', '\n', 'g'), '^\s+|\s+$', '', 'g')".replace("'\\n', 'g')", "chr(10), 'g')")

ORACLES = {
    "rubric_cases": RUBRIC_SQL + "SELECT * FROM rc",
    "rubric_batches": RUBRIC_SQL + "SELECT * FROM bt",
    "rubric_winners": RUBRIC_SQL + "SELECT * FROM win",
    "rubric_assertions": RUBRIC_SQL
    + "SELECT result_id, coalesce(verdict = 'correct' and coalesce(imprint_similarity, 0) >= 0.8, false) AS passes, coalesce(evidence >= 18, false) AS evidence_passes, coalesce(hallucination >= 15, false) AS hallucination_passes, coalesce(clarity >= 12, false) AS clarity_passes FROM rc",
    "arena_leaderboard": RUBRIC_SQL + """, points AS (SELECT run_id, provider, model, case verdict when 'correct' then 1.0 when 'partial' then 0.5 when 'wrong' then 0.0 end AS p FROM rc),
    pc AS (SELECT provider, model, count(DISTINCT run_id) AS batches, count(p) AS rated, round(avg(p) * 100, 4) AS accuracy FROM points GROUP BY ALL),
    rk AS (SELECT run_id, model, total, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, model) AS k FROM bt WHERE total IS NOT NULL),
    vt AS (SELECT n.run_id, case when n < 2 then '' when a.total - b.total <= 1 then 'tie' else a.model end AS vote FROM (SELECT run_id, count(total) AS n FROM bt GROUP BY 1) n LEFT JOIN rk a ON a.run_id = n.run_id AND a.k = 1 LEFT JOIN rk b ON b.run_id = n.run_id AND b.k = 2),
    sm AS (SELECT provider, model, round(sum(round(total * 10000)::bigint) / count(total) / 10000, 4) AS mean_total, count(*) filter (vote = model) AS wins, count(*) filter (vote = 'tie') AS ties FROM bt LEFT JOIN vt USING (run_id) GROUP BY ALL)
    SELECT * FROM pc LEFT JOIN sm USING (provider, model)""",
    "login_limits": """WITH e AS (SELECT event_id, user_id::varchar AS limit_key, epoch(ts)::bigint AS ms FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)),
    l AS (SELECT limit_key, list({'id': event_id, 'at': ms, 's': ms, 'c': 1} ORDER BY ms, event_id) AS es FROM e WHERE limit_key IS NOT NULL GROUP BY 1),
    f AS (SELECT limit_key, list_reduce(list_transform(es, lambda e: [e]), lambda acc, x: list_append(acc, case when x[1].at - acc[-1].s >= 600000 then {'id': x[1].id, 'at': x[1].at, 's': x[1].at, 'c': 1} else {'id': x[1].id, 'at': x[1].at, 's': acc[-1].s, 'c': acc[-1].c + 1} end)) AS s FROM l),
    u AS (SELECT limit_key, unnest(s) AS s FROM f) SELECT s.id AS event_id, limit_key, s.c AS count, s.c <= 5 AS allowed, greatest(0, s.s + 600000 - s.at) AS retry_after_ms FROM u""",
    "sheet_validation": _VALIDATION,
    "orphan_images": f"WITH {_IMAGES} SELECT * FROM files WHERE image_key NOT IN (SELECT unnest([{_key('images.front')}, {_key('images.back')}]) FROM gt_record)",
    "duplicate_images": f"WITH {_IMAGES} SELECT * FROM files WHERE n_files > 1",
    "sheet_truth": f"""SELECT row_id, {trim_sql("case_id")} AS sample_id, not regexp_matches(lower({trim_sql("expected_readable")}), '^(?:false|0|no|n)$|불가|unreadable') AS expected_readable,
    case {_variant("blur", "없음|선명|정상|none|clear|original")} {_variant("angle", "정면|정상|0|front|original")} {_variant("light", "정상|일반|공식|공식등록|normal|standard|original")}
    {_variant("background", "단순|흰색|백색|plain|white|standard|original")} else 'original' end AS variant FROM answer_sheet""",
    "truth_errors": f"SELECT gt_id, concat_ws('|', case when coalesce(schema_version, '') <> '1.0' then 'schema_version' end, case when {trim_sql('sample_id')} = '' then 'sample_id' end, case when answer is null then 'answer' end, case when condition is null then 'condition' end, case when {trim_sql('images.front')} = '' then 'images.front' end) AS errors FROM gt_record",
    "result_errors": f"""SELECT result_id, concat_ws('|', case when coalesce(schema_version, '') <> '1.0' then 'schema_version' end, case when {trim_sql("run_id")} = '' then 'run_id' end, case when {trim_sql("sample_id")} = '' then 'sample_id' end,
    case when {trim_sql("model")} = '' then 'model' end, case when coalesce(provider, '') not in ('northlight', 'deltaforge', 'lumenworks', 'mock') then 'provider' end, case when prediction is null and coalesce(error, '') = '' then 'prediction' end,
    case when prediction.confidence is not null and not (prediction.confidence between 0 and 100) then 'prediction.confidence' end, {_NUMBERS}) AS errors FROM research_result""",
    "error_classes": f"""WITH e AS (SELECT lower({trim_sql("error")}) AS e FROM research_result), k AS (SELECT case when e = '' then null when regexp_matches(e, 'auth|unauthor|forbidden|api.?key|permission') then 'authentication'
    when regexp_matches(e, 'quota|billing|credit|insufficient_quota') then 'quota' when regexp_matches(e, 'rate.?limit|too many requests') then 'rate_limit' when regexp_matches(e, 'model.*(?:not found|invalid|unsupported|not allowed|access)|invalid_model') then 'invalid_model'
    when regexp_matches(e, 'timeout|timed out|aborterror') then 'timeout' when regexp_matches(e, 'invalid.?request|bad.?request') then 'invalid_request' else 'upstream' end AS kind FROM e)
    SELECT kind, count(*) AS n, coalesce(kind in ('timeout', 'rate_limit', 'upstream'), false) AS retryable FROM k GROUP BY ALL""",
    "confidence_scales": """SELECT result_id, case when c is not null then round(least(1, greatest(0, case when c > 1 then c / 100 else c end)), 6) end AS unit, case when c is not null then round(least(1, greatest(0, case when c > 1 and c <= 100 then c / 100 else c end)), 6) end AS rubric,
    case when c between 0 and 100 then round(c, 6) end AS contract, case when c is not null then round(least(100, greatest(0, c)), 6) end AS clamped FROM (SELECT result_id, prediction.confidence AS c FROM research_result)""",
    "registry_first": f"""WITH f AS (SELECT q, arg_min(entry_id, (fetched_at, entry_id)) AS entry_id FROM pill_registry WHERE trim(coalesce(q, '')) <> '' GROUP BY 1)
    SELECT entry_id, q, n, {mark_sql("pf")} AS front, {mark_sql("pb")} AS back,
    array_to_string({colors_sql("k1")}, '|') AS colors
    FROM f JOIN pill_registry USING (q, entry_id)""",
    "registry_merge": "SELECT DISTINCT q, n, null::int AS x FROM pill_registry WHERE x IS NULL UNION ALL SELECT DISTINCT q, n, 1 FROM pill_registry WHERE q NOT IN (SELECT q FROM pill_registry WHERE x IS NULL)",
    "registry_history": "SELECT q, max(fetched_at)::date::varchar AS last_seen FROM pill_registry WHERE q NOT IN (SELECT q FROM pill_registry WHERE x IS NULL) GROUP BY 1",
    "registry_tags": r"""WITH l AS (SELECT DISTINCT regexp_extract(n, '\(([가-힣]{2,})', 1) AS kr FROM pill_registry), k AS (SELECT kr, ['마약', '향정신성의약품', '기타'][length(kr) % 3 + 1] AS type FROM l WHERE kr <> ''),
    e AS (SELECT DISTINCT q, regexp_replace(n, '\s+', '', 'g') AS n FROM pill_registry), h AS (SELECT q, arg_max(type, length(kr)) AS nc FROM e JOIN k ON contains(e.n, kr) WHERE NOT contains(e.n, '아포모르핀') GROUP BY 1) SELECT * FROM h WHERE nc <> '기타'""",
    "registry_efficacy": """WITH f AS (SELECT * FROM efficacy WHERE coalesce(ef, '') <> '' OR coalesce("at", '') <> ''), p AS (SELECT q, arg_min({'ef': coalesce(ef, ''), 'at': coalesce("at", '')}, eff_id) AS r FROM f WHERE src = 'prm' GROUP BY 1),
    s AS (SELECT q, arg_min({'ef': coalesce(ef, ''), 'at': coalesce("at", '')}, eff_id) AS r FROM f WHERE src = 'easy' GROUP BY 1),
    j AS (SELECT g.q, p.r AS pr, s.r AS er, case when p.r.ef <> '' then 'prm' when s.r.ef <> '' then 'easy' when p.r.at <> '' then 'prm' when s.r.at <> '' then 'easy' end AS src FROM (SELECT DISTINCT q FROM pill_registry) g LEFT JOIN p USING (q) LEFT JOIN s USING (q))
    SELECT q, case src when 'prm' then pr.ef else er.ef end AS ef, case src when 'prm' then pr.at else er.at end AS "at", src FROM j WHERE src IS NOT NULL""",
    "doc_scores": DOCS_SQL + "SELECT * FROM ds",
    "doc_summary": DOCS_SQL + f"""SELECT condition, count(*) AS docs, count(*) filter (complete) AS complete_docs, {percent_sql("count(*) filter (complete)", "count(*)")} AS complete_rate, sum(items) AS items, sum(covered) AS covered_items, {percent_sql("sum(covered)", "sum(items)")} AS item_recall,
    sum(missed) AS missed_items, floor(sum(missed) / count(*) * 100 + 0.5) / 100 AS mean_missed, count(*) filter (missed = 0) AS missed_none, count(*) filter (missed = 1) AS missed_one, count(*) filter (missed >= 2) AS missed_more, floor(avg(over_redaction) * 100 + 0.5) / 100 AS mean_over_redaction FROM ds GROUP BY 1""",
    "doc_types": DOCS_SQL + f"SELECT type, count(*) AS items, count(*) filter (covered) AS covered, {percent_sql('count(*) filter (covered)', 'count(*)')} AS recall, type in ('주민등록번호', '개인식별번호') AS high_risk FROM sc GROUP BY 1",
    "doclog_summary": _LOG + f"""SELECT condition, count(*) AS docs, count(*) filter (not bad) AS ocr_succeeded, {percent_sql("count(*) filter (not bad)", "count(*)")} AS ocr_success_rate, {", ".join(f"{_IS(o)} AS n_{o}" for o in ("auto", "manual_assisted", "manual_only", "failed"))},
    {percent_sql(_IS("auto"), "count(*)")} AS auto_rate, {percent_sql(_IS("manual_assisted") + " + " + _IS("manual_only"), "count(*)")} AS touched_rate, {percent_sql(_IS("manual_only"), _IS("manual_only") + " + " + _IS("failed"))} AS recovery_rate, {percent_sql(_IS("failed"), "count(*)")} AS failed_rate,
    floor((avg(conf) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS mean_confidence, floor(avg(ms) filter (ms > 0) + 0.5) AS mean_elapsed_ms FROM o GROUP BY 1""",
    "doclog_kinds": _LOG + "SELECT 'a' AS kind, sum(au) AS count FROM o UNION ALL SELECT 'b', sum(ma) FROM o",
    "column_parts": WORDS_SQL + """, g AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, row_no ORDER BY x0, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
    SELECT doc_id, page, word_no, row_no, sum(coalesce(x0 - reach > 60, false)::int) OVER (PARTITION BY doc_id, page, row_no ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS part_no FROM g""",
    "nearest_columns": WORDS_SQL + "SELECT doc_id, page, word_no AS cell_no, arg_min(a, (abs(a * 170 - (x0 + x1) / 2), a)) AS anchor_no FROM p, range(6) r(a) GROUP BY ALL",
    "runs_merged": "SELECT max(result_id) AS result_id, run_id FROM research_result GROUP BY run_id, sample_id, provider, model, created_at",
    "runs_new": "SELECT result_id, run_id FROM research_result r WHERE received_at > created_at + INTERVAL 1 HOUR AND NOT EXISTS (SELECT 1 FROM research_result o WHERE o.received_at <= o.created_at + INTERVAL 1 HOUR AND o.run_id = r.run_id AND o.provider = r.provider)",
    "runs_retained": "SELECT result_id FROM research_result ORDER BY created_at DESC NULLS LAST, result_id DESC LIMIT 100",
    "markup_texts": f"SELECT eff_id, length(t) AS n, md5(t) AS digest FROM (SELECT eff_id, {_CLEAN} AS t FROM efficacy)",
}

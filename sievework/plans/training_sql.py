"""SQL of the shredding and record-loading queries."""

from __future__ import annotations

from collections.abc import Sequence

from sievework.operators.records import SHEET_COLUMNS

_FILLED = r"[^\s\p{Z}\p{Cc}]"


def _listed(x: str) -> str:
    """The entries of a JSON list, or of an object keyed by place."""
    return f"(case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'OBJECT' then list_transform(json_keys({x}), lambda k: json_extract({x}, '$.\"' || k || '\"')) else [] end)"


def _values(x: str) -> str:
    """How many children of an object are neither null nor blank text."""
    kid = f"json_extract({x}, '$.\"' || k || '\"')"
    one = rf"json_type({kid}) <> 'NULL' and (json_type({kid}) <> 'VARCHAR' or regexp_matches(json_extract_string({kid}, '$'), '{_FILLED}'))"
    return f"len(list_filter(json_keys({x}), lambda k: {one}))"


def _scalar(x: str, field: str) -> str:
    return f"case when json_type({x}, '$.{field}') not in ('OBJECT', 'ARRAY') then json_extract_string({x}, '$.{field}') end AS \"{field}\""


_DATASETS = f"""WITH b AS (SELECT dataset_id, case when json_valid(body) then body::json end AS j FROM result_dataset WHERE trim(coalesce(body, '')) <> ''),
a AS (SELECT dataset_id, unnest([json_extract(j, '$.samples'), json_extract(j, '$.dataset.samples')]) AS s FROM b),
c AS (SELECT dataset_id, case when json_type(s) = 'VARCHAR' then case when json_valid(json_extract_string(s, '$')) then json_extract_string(s, '$')::json end else s end AS s FROM a WHERE s IS NOT NULL),
e AS (SELECT dataset_id, {_listed("s")} AS items FROM c),
s AS (SELECT * FROM (SELECT dataset_id, unnest(items) AS o, generate_subscripts(items, 1) - 1 AS sample_pos FROM e) WHERE json_type(o) = 'OBJECT'),
k AS (SELECT dataset_id, sample_pos, unnest(['answer', 'condition', 'prediction', 'metrics', 'error', 'meta', 'attempt']) AS child,
    unnest([json_extract(o, '$.answer'), json_extract(o, '$.condition'), json_extract(o, '$.prediction'), json_extract(o, '$.metrics'), json_extract(o, '$.error'), case when json_type(o, '$.meta') = 'OBJECT' then json_extract(o, '$.meta') end, case when json_type(o, '$.meta') = 'OBJECT' then json_extract(o, '$.meta.attempts') end]) AS v FROM s),
l AS (SELECT dataset_id, sample_pos, child, case json_type(v) when 'OBJECT' then [v] when 'ARRAY' then json_extract(v, '$[*]') else [] end AS items FROM k),
p AS (SELECT * FROM (SELECT dataset_id, sample_pos, child, unnest(items) AS o, generate_subscripts(items, 1) - 1 AS child_pos FROM l) WHERE json_type(o) = 'OBJECT')
"""


def _text_fields(names: Sequence[str], struct: str) -> str:
    return " + ".join(f"coalesce(regexp_matches({struct}.{n}, '{_FILLED}'), false)::int" for n in names)


_ANSWER = ("mfds_item_id", "drug_name", "front_imprint", "back_imprint", "shape", "color")
_CONDITION = ("light", "background", "blur", "angle", "variant")
_ANSWER_N = _text_fields(_ANSWER, "answer")
_CONDITION_N = _text_fields(_CONDITION, "condition") + " + (condition.expected_readable IS NOT NULL)::int"


def _flat(child: str, fields: Sequence[str]) -> str:
    return f"SELECT 'result_dataset' AS parent_kind, dataset_id AS parent_id, sample_pos, child_pos, {_values('o')} AS n_values, {', '.join(_scalar('o', f) for f in fields)} FROM p WHERE child = '{child}'"


# a field is wholly quoted, with inner quotes doubled, or has no quote
_SHEETS = r"""WITH h AS (SELECT sheet_id, regexp_replace(regexp_replace(arg_min(raw, rec_id), '^\x{FEFF}', ''), '[\r\n]+$', '') AS t FROM sheet_record WHERE rec_no = 1 AND sheet_id IS NOT NULL GROUP BY 1),
u AS (SELECT sheet_id, t, regexp_replace(t, '"(?:[^"]|"")*"', '', 'g') AS bare FROM h),
m AS (SELECT *, length(bare) - length(replace(bare, ',', '')) AS nc, length(bare) - length(replace(bare, chr(9), '')) AS nt, length(bare) - length(replace(bare, ';', '')) AS ns FROM u),
d AS (SELECT sheet_id, t, case when nc >= nt and nc >= ns then ',' when nt >= ns then chr(9) else ';' end AS sep, greatest(nc, nt, ns) + 1 AS width FROM m),
hn AS (SELECT sheet_id, sep, width, list_transform(regexp_extract_all(sep || t, sep || '("(?:[^"]|"")*"|[^"' || sep || ']*)', 1), lambda x: regexp_replace(lower(trim(case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end)), '[\s\-_]+', '_', 'g')) AS names
    FROM d WHERE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"' || sep || ']*)(?:' || sep || '(?:"(?:[^"]|"")*"|[^"' || sep || ']*))*')),
r AS (SELECT rec_id, s.sheet_id, rec_no, sep, width, names, regexp_replace(regexp_replace(raw, '^\x{FEFF}', ''), '[\r\n]+$', '') AS t FROM sheet_record s LEFT JOIN hn USING (sheet_id) WHERE coalesce(rec_no, 0) <> 1),
q AS (SELECT *, regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"' || sep || ']*)(?:' || sep || '(?:"(?:[^"]|"")*"|[^"' || sep || ']*))*') AS ok FROM r),
v AS (SELECT *, case when ok then list_transform(regexp_extract_all(sep || t, '(?s)' || sep || '("(?:[^"]|"")*"|[^"' || sep || ']*)', 1), lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end AS f FROM q),
w AS (SELECT *, """ + ", ".join(f"case when list_position(names, '{c}') > 0 then coalesce(f[list_position(names, '{c}')], '') else '' end AS {c}" for c in SHEET_COLUMNS) + r""" FROM v),
i AS (SELECT *, trim(regexp_replace(case_id, '^\s+|\s+$', '', 'g')) AS cid, regexp_replace(front_image, '^\s+|\s+$', '', 'g') AS fi, regexp_replace(back_image, '^\s+|\s+$', '', 'g') AS bi FROM w),
z AS (SELECT *, case when t IS NULL then 'null_record' when sep IS NULL then 'no_header' when not ok then 'quoting' when len(f) <> width then 'field_count' when not regexp_full_match(cid, '[A-Za-z]+[-_][0-9]+') then 'bad_case_id'
    when not regexp_full_match(fi, '(?is)(?:.*[/\\])?[^/\\]*[^/\\\s][^/\\]*\.(?:jpe?g|png|webp|heic)') then 'bad_front_image' when not regexp_full_match(bi, '(?is)(?:.*[/\\])?[^/\\]*[^/\\\s][^/\\]*\.(?:jpe?g|png|webp|heic)') then 'bad_back_image'
    when lower(regexp_extract(fi, '[^/\\]*$')) = lower(regexp_extract(bi, '[^/\\]*$')) then 'same_image' end AS reason FROM i)
"""

ORACLES = {
    "p2_found": _DATASETS + f"""SELECT 'gt_record' AS parent_kind, gt_id AS parent_id, 0 AS sample_pos, 'answer' AS child, 0 AS child_pos FROM gt_record WHERE {_ANSWER_N} > 0
    UNION ALL SELECT 'gt_record', gt_id, 0, 'condition', 0 FROM gt_record WHERE {_CONDITION_N} > 0
    UNION ALL SELECT 'result_dataset', dataset_id, sample_pos, 'sample', 0 FROM s WHERE {_values("o")} > 0 UNION ALL SELECT 'result_dataset', dataset_id, sample_pos, child, child_pos FROM p WHERE {_values("o")} > 0""",
    "p2_samples": _DATASETS + f"SELECT 'result_dataset' AS parent_kind, dataset_id AS parent_id, sample_pos, {_values('o')} AS n_values, {', '.join(_scalar('o', f) for f in ('sample_id', 'run_id', 'provider', 'model', 'variant', 'classification', 'error'))} FROM s",
    "p2_answers": _DATASETS + _flat("answer", _ANSWER) + f" UNION ALL SELECT 'gt_record', gt_id, 0, 0, {_ANSWER_N}, {', '.join(f'answer.{c}' for c in _ANSWER)} FROM gt_record WHERE answer IS NOT NULL",
    "p2_conditions": _DATASETS + _flat("condition", ("expected_readable", *_CONDITION, "notes"))
    + f" UNION ALL SELECT 'gt_record', gt_id, 0, 0, {_CONDITION_N}, condition.expected_readable::varchar, {', '.join(f'condition.{c}' for c in _CONDITION)}, null FROM gt_record WHERE condition IS NOT NULL",
    "p2_attempts": _DATASETS + _flat("attempt", ("attempt_no", "latency_ms", "error")),
    "p2_sample_predictions": _DATASETS + _flat("prediction", ("drug_name", "drug_code", "front_imprint", "back_imprint", "shape", "color", "confidence", "evidence", "uncertainty")),
    "p2_sample_metrics": _DATASETS
    + _flat("metrics", (
        "exact_match", "partial_match", "drug_name_similarity", "front_imprint_similarity", "back_imprint_similarity", "imprint_CER", "front_imprint_CER", "back_imprint_CER", "imprint_orientation",
        "confidence", "Brier_loss", "latency", "error_rate", "completeness",
    )),
    "p2_sample_errors": _DATASETS + _flat("error", ("code", "message", "detail")),
    "p2_sample_meta": _DATASETS + _flat("meta", ("variant", "detail", "attempts")).replace(" child_pos,", ""),
    "p3_found": _SHEETS + "SELECT rec_id FROM z WHERE reason IS NOT NULL AND rec_no > 1",
    "p3_loaded": _SHEETS + f"SELECT rec_id, sheet_id, rec_no, {', '.join(SHEET_COLUMNS)}, case when lower(trim(expected_readable)) in ('true', '1', 'y', 'yes') then true when lower(trim(expected_readable)) in ('false', '0', 'n', 'no') then false end AS readable FROM z WHERE reason IS NULL",
}


def _inside(rows: str, label: str, place: str) -> str:
    """Objects under ``label`` of the objects ``o`` of ``rows``, one or a list, with their place."""
    listed = f"case json_type(o, '$.{label}') when 'OBJECT' then [json_extract(o, '$.{label}')] when 'ARRAY' then json_extract(o, '$.{label}[*]') else [] end"
    return f"SELECT * EXCLUDE (o) RENAME (inner_o AS o) FROM (SELECT *, unnest({listed}) AS inner_o, generate_subscripts({listed}, 1) - 1 AS {place} FROM {rows}) WHERE json_type(inner_o) = 'OBJECT'"


def _nested(child: str, label: str, place: str, fields: Sequence[str]) -> str:
    inner = _inside(f"(SELECT * FROM p WHERE child = '{child}')", label, place)
    return f"SELECT 'result_dataset' AS parent_kind, dataset_id AS parent_id, sample_pos, child_pos, {place}, {_values('o')} AS n_values, {', '.join(_scalar('o', f) for f in fields)} FROM ({inner})"


_ATTEMPT_ERRORS = _inside("(SELECT * FROM p WHERE child = 'attempt')", "error", "error_pos")
ORACLES |= {
    "p2_condition_notes": _DATASETS + _nested("condition", "notes", "note_pos", ("by", "tags")),
    "p2_condition_tags": _DATASETS
    + f"""SELECT 'result_dataset' AS parent_kind, dataset_id AS parent_id, sample_pos, child_pos, note_pos, tag_pos, json_extract_string(t, '$') AS tag FROM (SELECT *, unnest(json_extract(o, '$.tags[*]')) AS t, generate_subscripts(json_extract(o, '$.tags[*]'), 1) - 1 AS tag_pos
    FROM ({_inside("(SELECT * FROM p WHERE child = 'condition')", "notes", "note_pos")}) WHERE json_type(o, '$.tags') = 'ARRAY') WHERE json_type(t) NOT IN ('NULL', 'OBJECT', 'ARRAY')""",
    "p2_attempt_errors": _DATASETS + _nested("attempt", "error", "error_pos", ("code", "message", "detail")),
    "p2_attempt_error_details": _DATASETS
    + f"SELECT 'result_dataset' AS parent_kind, dataset_id AS parent_id, sample_pos, child_pos, error_pos, detail_pos, {_values('o')} AS n_values, {_scalar('o', 'wait_s')} FROM ({_inside('(' + _ATTEMPT_ERRORS + ')', 'detail', 'detail_pos')})",
}

"""SQL fragments shared by the check queries."""

from __future__ import annotations


def R(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def area(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)*({a}.z2-{a}.z1))"


def inter(a: str, b: str) -> str:
    return "(" + "*".join(
        f"greatest(least({a}.{c}2,{b}.{c}2)-greatest({a}.{c}1,{b}.{c}1),0.0)" for c in "xyz"
    ) + ")"


def iou(a: str, b: str) -> str:
    return f"({inter(a, b)}/({area(a)}+{area(b)}-{inter(a, b)}))"


def overlap(a: str, b: str) -> str:
    return "(" + " AND ".join(
        f"least({a}.{c}2,{b}.{c}2) > greatest({a}.{c}1,{b}.{c}1)" for c in "xyz"
    ) + ")"


def match_sql(
    name: str,
    det: str = "det",
    gt: str = "gt",
    keys: str = "case_id",
    thr: str = "0.1",
    pref: str = "iou DESC, gt_id",
    order: str = "score DESC, det_id",
    score: str = "score",
) -> str:
    """Replay of the sequential matching: view ``name(keys, det_id, score, gt_id)``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"d.{k}=g.{k}" for k in ks)
    dk = ", ".join(f"d.{k}" for k in ks)
    rk = ", ".join(f"r.{k}" for k in ks)
    sr = " AND ".join(f"s.{k}=r.{k}" for k in ks)
    return f"""
    {name}_p AS (SELECT {dk}, d.det_id, d.{score} AS score, g.*EXCLUDE({', '.join(ks)}), {iou('d', 'g')} AS iou
        FROM {det} d LEFT JOIN {gt} g ON {on} AND {overlap('d', 'g')} AND {iou('d', 'g')} >= {thr}),
    {name}_w AS (SELECT {keys}, det_id, score, coalesce(list(gt_id ORDER BY {pref}) FILTER (WHERE gt_id IS NOT NULL), []) AS w
        FROM {name}_p GROUP BY {keys}, det_id, score),
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {name}_w),
    {name}_s AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used,
                        CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS gt_id FROM {name}_r
        UNION ALL
        SELECT {keys}, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, det_id, score, pick
        FROM (SELECT {rk}, r.rn, s.used, r.det_id, r.score,
                     list_filter(r.w, lambda q: NOT list_contains(s.used, q))[1] AS pick
              FROM {name}_s s JOIN {name}_r r ON {sr} AND r.rn = s.rn + 1)),
    {name} AS (SELECT {keys}, det_id, score, gt_id FROM {name}_s WHERE rn > 0)"""


def keep_sql(
    name: str,
    det: str = "det",
    keys: str = "case_id",
    conflict: str = "",
    order: str = "score DESC, det_id",
) -> str:
    """Replay of greedy suppression: view ``name(keys, det_id)`` of kept boxes.

    ``conflict`` compares a better box ``k`` with a worse box ``d``.
    """
    ks = [k.strip() for k in keys.split(",")]
    kd = " AND ".join(f"k.{k}=d.{k}" for k in ks)
    sr = " AND ".join(f"s.{k}=r.{k}" for k in ks)
    dk = ", ".join(f"d.{k}" for k in ks)
    rk = ", ".join(f"r.{k}" for k in ks)
    return f"""
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {det}),
    {name}_e AS (SELECT {dk}, d.rn, d.det_id,
                        coalesce(list(k.rn) FILTER (WHERE k.rn IS NOT NULL), []) AS better
        FROM {name}_r d LEFT JOIN {name}_r k ON {kd} AND k.rn < d.rn AND {conflict} GROUP BY {dk}, d.rn, d.det_id),
    {name}_s AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept,
                        CAST(NULL AS BIGINT) AS det_id, false AS keep FROM {name}_r
        UNION ALL
        SELECT {rk}, r.rn, CASE WHEN list_has_any(s.kept, r.better) THEN s.kept ELSE list_append(s.kept, r.rn) END,
               r.det_id, NOT list_has_any(s.kept, r.better)
        FROM {name}_s s JOIN {name}_e r ON {sr} AND r.rn = s.rn + 1),
    {name} AS (SELECT {keys}, det_id FROM {name}_s WHERE keep)"""


#: The table of 256 steps of CRC-32 as one list ``steps``, a common table expression.
CRC_STEPS = """crc_steps AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the bytes of ``text``, beside a row of ``crc_steps``."""
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])))"

"""The registered queries as SQL over the same tables, built from common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from catalog.queries import ITERATIONS, RANK

PURCHASES = (
    "SELECT o_custkey AS user_raw, l_partkey AS item_raw, l_quantity AS rating, o_orderdate AS ts "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
EVENTS = (
    "SELECT user_id AS user_raw, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_raw, "
    '"value" AS rating, ts FROM events'
)


class Script:
    """A WITH list under construction."""

    def __init__(self):
        self._steps: list[str] = []

    def add(self, name: str, sql: str) -> str:
        self._steps.append(f"{name} AS MATERIALIZED (\n{sql}\n)")
        return name

    def select(self, sql: str) -> str:
        return "WITH " + ",\n".join(self._steps) + "\n" + sql if self._steps else sql


# Preparation


def positives(script: Script, name: str, source: str, threshold: float) -> str:
    return script.add(
        name, f"SELECT user_raw, item_raw, 1.0::DOUBLE AS rating, ts FROM ({source}) WHERE rating > {threshold} AND NOT isnan(rating)"
    )


def core(script: Script, name: str, source: str, min_user: int, min_item: int, passes: int = 6) -> str:
    """Passes beyond the fixpoint change nothing."""
    for number in range(passes):
        for side, minimum in (("user_raw", min_user), ("item_raw", min_item)):
            if minimum > 0:
                source = script.add(
                    f"{name}_{number}_{side}",
                    f"SELECT * FROM {source} WHERE {side} IN "
                    f"(SELECT {side} FROM {source} GROUP BY {side} HAVING count(*) >= {minimum})",
                )
    return source


def sample_condition(users: str, column: str, fraction: float) -> str:
    return (
        f"{column} IN (SELECT {column} FROM (SELECT DISTINCT {column} FROM {users}) "
        f"ORDER BY md5(concat('42:', {column})), {column} "
        f"LIMIT (SELECT greatest(1, CAST(floor(count(DISTINCT {column}) * {fraction}) AS BIGINT)) FROM {users}))"
    )


def index(script: Script, name: str, source: str, raw: str, number: str) -> str:
    return script.add(
        name, f"SELECT {raw}, row_number() OVER (ORDER BY {raw}) - 1 AS {number} FROM (SELECT DISTINCT {raw} FROM {source})"
    )


def numbered(script: Script, prefix: str, source: str) -> str:
    index(script, f"{prefix}_users", source, "user_raw", "user_id")
    index(script, f"{prefix}_items", source, "item_raw", "item_id")
    return script.add(
        f"{prefix}_rows",
        f"SELECT user_id, item_id, rating, ts FROM {source} JOIN {prefix}_users USING (user_raw) JOIN {prefix}_items USING (item_raw)",
    )


def split(script: Script, prefix: str, rows: str) -> None:
    script.add(
        f"{prefix}_test",
        "SELECT user_id, item_id FROM (SELECT user_id, item_id, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS place, "
        f"count(*) OVER (PARTITION BY user_id) AS total FROM {rows}) WHERE place = 1 AND total > 1",
    )
    script.add(
        f"{prefix}_train",
        f"SELECT DISTINCT user_id, item_id FROM {rows} r WHERE NOT EXISTS "
        f"(SELECT 1 FROM {prefix}_test t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)",
    )


def prepared(
    script: Script, prefix: str, source: str, threshold: float = 0.0, min_user: int = 10, min_item: int = 10, fraction: float = 1.0
) -> None:
    """CTEs prefix_users, prefix_items, prefix_rows, prefix_test and prefix_train."""
    rows = core(script, f"{prefix}_core", positives(script, f"{prefix}_pos", source, threshold), min_user, min_item)
    if fraction < 1.0:
        rows = script.add(f"{prefix}_sample", f"SELECT * FROM {rows} WHERE {sample_condition(rows, 'user_raw', fraction)}")
    split(script, prefix, numbered(script, prefix, rows))


# Factors


def _start(rank: int, factor: int, step: int, shift: int, modulus: int) -> str:
    return ", ".join(
        f"CAST((id * {factor} + {f * step + shift}) % {modulus} - {modulus // 2} AS DOUBLE) / {modulus * 50.0}::DOUBLE AS f{f}"
        for f in range(rank)
    )


def start_factors(script: Script, prefix: str, rank: int, weights: str) -> None:
    """prefix_p (id, f*) and prefix_q (id, c, f*); ``weights`` selects (item_id, c)."""
    script.add(f"{prefix}_p", f"SELECT id, {_start(rank, 7919, 104729, 13, 997)} FROM (SELECT user_id AS id FROM {prefix}_users)")
    script.add(
        f"{prefix}_q",
        f"SELECT id, c, {_start(rank, 6007, 15013, 29, 991)} FROM (SELECT item_id AS id FROM {prefix}_items) "
        f"JOIN ({weights}) w ON w.item_id = id",
    )


def popularity(prefix: str, total: float = 512.0, exponent: float = 0.4) -> str:
    counts = (
        f"SELECT i.item_id, count(t.item_id) AS n FROM {prefix}_items i "
        f"LEFT JOIN {prefix}_train t ON t.item_id = i.item_id GROUP BY i.item_id"
    )
    return (
        f"SELECT item_id, n, {total}::DOUBLE * pow(n::DOUBLE, {exponent}::DOUBLE) / "
        f"sum(pow(n::DOUBLE, {exponent}::DOUBLE)) OVER () AS c FROM ({counts})"
    )


def constant(prefix: str, weight: float) -> str:
    return f"SELECT item_id, {weight}::DOUBLE AS c FROM {prefix}_items"


def _cells(rank: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(rank) for b in range(a, rank)]


def _cell(name: str, a: int, b: int) -> str:
    return f"{name}_{min(a, b)}_{max(a, b)}"


def half_step(
    script: Script, name: str, own: str, other: str, train: str, keys: tuple[str, str], rank: int,
    users: bool, c_obs: float, target: float, reg: float = 0.01,
) -> str:
    """One element-wise pass from sums per row: A = observed part + missing part + reg on the diagonal."""
    own_key, other_key = keys
    weight = f"({c_obs}::DOUBLE - o.c)" if users else "1.0::DOUBLE"
    sums = [f"sum(o.f{a}) AS s_{a}" for a in range(rank)]
    sums += [f"sum({weight} * o.f{a} * o.f{b}) AS {_cell('g', a, b)}" for a, b in _cells(rank)]
    script.add(
        f"{name}_sums",
        f"SELECT t.{own_key} AS row_id, {', '.join(sums)} FROM {train} t JOIN {other} o ON o.id = t.{other_key} GROUP BY t.{own_key}",
    )
    scale = "c * " if users else ""
    gram = [f"sum({scale}f{a} * f{b}) AS {_cell('m', a, b)}" for a, b in _cells(rank)]
    script.add(f"{name}_gram", f"SELECT {', '.join(gram)} FROM {other}")

    def system(a: int, b: int) -> str:
        observed, missing = _cell("g", a, b), _cell("m", a, b)
        diagonal = f" + {reg}::DOUBLE" if a == b else ""
        if users:
            return f"({observed} + {missing}{diagonal})"
        return f"(({c_obs}::DOUBLE - c) * {observed} + c * {missing}{diagonal})"

    updates = []
    for f in range(rank):
        others = "".join(f" - {system(f, g)} * {'n' if g < f else 'f'}{g}" for g in range(rank) if g != f)
        value = f"({c_obs * target}::DOUBLE * s_{f}{others}) / {system(f, f)}"
        updates.append(f"CASE WHEN row_id IS NULL THEN f{f} ELSE {value} END AS n{f}")
    kept = "id" if users else "id, c"
    values = ", ".join(f"n{f} AS f{f}" for f in range(rank))
    return script.add(
        name,
        f"SELECT {kept}, {values} FROM (SELECT *, {', '.join(updates)} "
        f"FROM {own} LEFT JOIN {name}_sums ON row_id = id CROSS JOIN {name}_gram)",
    )


def train(
    script: Script, prefix: str, rank: int, iterations: int, c_obs: float = 1.0, target: float = 1.0
) -> list[tuple[str, str]]:
    """(user table, item table) after each iteration, from prefix_p and prefix_q."""
    p, q, steps = f"{prefix}_p", f"{prefix}_q", []
    pairs = f"{prefix}_train"
    for number in range(1, iterations + 1):
        p = half_step(script, f"{prefix}_p{number}", p, q, pairs, ("user_id", "item_id"), rank, True, c_obs, target)
        q = half_step(script, f"{prefix}_q{number}", q, p, pairs, ("item_id", "user_id"), rank, False, c_obs, target)
        steps.append((p, q))
    return steps


def dot(rank: int, left: str, right: str) -> str:
    return " + ".join(f"{left}.f{f} * {right}.f{f}" for f in range(rank))


def loss(p: str, q: str, pairs: str, rank: int, c_obs: float = 1.0, reg: float = 0.01) -> str:
    """A scalar query."""
    cells = [(a, b) for a in range(rank) for b in range(rank)]
    user_gram = ", ".join(f"sum(f{a} * f{b}) AS u_{a}_{b}" for a, b in cells)
    item_gram = ", ".join(f"sum(c * f{a} * f{b}) AS i_{a}_{b}" for a, b in cells)
    trace = " + ".join(f"u_{a}_{b} * i_{b}_{a}" for a, b in cells)
    squares = " + ".join(f"f{f} * f{f}" for f in range(rank))
    score = dot(rank, "p", "q")
    return (
        f"(SELECT {trace} FROM (SELECT {user_gram} FROM {p}) CROSS JOIN (SELECT {item_gram} FROM {q})) + "
        f"(SELECT sum({c_obs}::DOUBLE * (1.0 - s) * (1.0 - s) - c * s * s) FROM (SELECT q.c, {score} AS s FROM {pairs} t "
        f"JOIN {p} p ON p.id = t.user_id JOIN {q} q ON q.id = t.item_id)) + "
        f"{reg}::DOUBLE * ((SELECT sum({squares}) FROM {p}) + (SELECT sum({squares}) FROM {q}))"
    )


# Ranking


def candidates(p: str, q: str, prefix: str, rank: int, users: str) -> str:
    """Unseen (user_id, item_id, score) of the users in ``users`` (user_id, ...)."""
    return (
        f"SELECT u.*, q.id AS candidate, {dot(rank, 'p', 'q')} AS score FROM {users} u JOIN {p} p ON p.id = u.user_id "
        f"CROSS JOIN {q} q WHERE NOT EXISTS (SELECT 1 FROM {prefix}_train t WHERE t.user_id = u.user_id AND t.item_id = q.id)"
    )


def ranks(script: Script, name: str, p: str, q: str, prefix: str, rank: int) -> str:
    target = (
        f"(SELECT t.user_id, t.item_id, {dot(rank, 'p', 'q')} AS bar FROM {prefix}_test t "
        f"JOIN {p} p ON p.id = t.user_id JOIN {q} q ON q.id = t.item_id)"
    )
    return script.add(
        name,
        "SELECT user_id, item_id, 1 + count(*) FILTER (WHERE score > bar OR (score = bar AND candidate < item_id)) AS rank "
        f"FROM ({candidates(p, q, prefix, rank, target)}) GROUP BY user_id, item_id",
    )


def metrics(k_values: Sequence[int], digits: int | None = 9) -> str:
    columns = []
    for k in k_values:
        hr = f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        ndcg = f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0.0::DOUBLE END)"
        columns += [f"round({hr}, {digits}) AS hr_{k}", f"round({ndcg}, {digits}) AS ndcg_{k}"]
    return ", ".join(columns)


def flat(table: str, side: str, rank: int = RANK, digits: int = 6) -> str:
    return f"SELECT '{side}' AS side, id, " + ", ".join(f"round(f{f}, {digits}) AS f{f}" for f in range(rank)) + f" FROM {table}"


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    found.update(_relational())
    found.update(_factorisation())
    found.update(_evaluation())
    found.update(_experiments())
    return found


def _relational() -> dict[str, str]:
    rows = f"({PURCHASES})"
    found = {
        "scan_interactions": PURCHASES,
        "scan_json_interactions": f"SELECT user_raw, item_raw, rating, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM ({EVENTS})",
        "scan_review_files": "SELECT CAST(user_raw AS VARCHAR) AS user_raw, CAST(item_raw AS VARCHAR) AS item_raw, rating, "
        f"date_trunc('second', ts) AS ts FROM {rows}",
        "scan_null_ids": "WITH kept AS (SELECT user_raw, item_raw, rating FROM (SELECT event_id, user_id AS user_raw, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_raw, \"value\" AS rating FROM events) "
        "WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND user_raw IS NOT NULL AND item_raw IS NOT NULL) "
        "SELECT dense_rank() OVER (ORDER BY user_raw) - 1 AS user_id, dense_rank() OVER (ORDER BY item_raw) - 1 AS item_id, rating FROM kept",
        **{
            f"sink_{kind}": "SELECT user_raw, count(*) AS n, CASE WHEN count(*) > 20 THEN 'more, than \"20\" of ' || user_raw END AS note "
            f"FROM {rows} GROUP BY user_raw"
            for kind in ("csv", "json")
        },
        "binarize": f"SELECT user_raw, item_raw, 1.0::DOUBLE AS rating, ts FROM {rows} WHERE rating > 25 AND NOT isnan(rating)",
        "user_counts": f"SELECT user_raw, count(*) AS n FROM {rows} GROUP BY user_raw",
        "item_counts": f"SELECT item_raw, count(*) AS n FROM {rows} GROUP BY item_raw",
    }

    script = Script()
    kept = core(script, "core", positives(script, "pos", PURCHASES, 25.0), 10, 10)
    found["core_filter"] = script.select(f"SELECT * FROM {kept}")

    script = Script()
    source = script.add("source", PURCHASES)
    numbered(script, "all", source)
    found["user_index"] = script.select("SELECT * FROM all_users")
    found["item_index"] = script.select("SELECT * FROM all_items")
    found["reindexed_interactions"] = script.select("SELECT * FROM all_rows")
    split(script, "all", "all_rows")
    found["loo_test"] = script.select("SELECT * FROM all_test")

    script = Script()
    source = script.add("source", PURCHASES)
    index(script, "kept", f"(SELECT * FROM {source} WHERE rating > 49 AND NOT isnan(rating))", "user_raw", "kept_id")
    found["id_map_compose"] = script.select("SELECT * FROM kept")

    script = Script()
    source = script.add("source", PURCHASES)
    found["subsample_users"] = script.select(f"SELECT * FROM source WHERE {sample_condition('source', 'user_raw', 0.25)}")

    script = Script()
    prepared(script, "d", PURCHASES)
    found["subsample_matrix"] = _sampled_matrix(script, "d", 0.25).select("SELECT user_id, item_id FROM sub_train")

    script = Script()
    prepared(script, "d", PURCHASES)
    found["train_ratings"] = script.select('SELECT user_id AS "user", item_id AS item, 1.0::DOUBLE AS rating FROM d_train')

    script = Script()
    source = script.add("source", EVENTS)
    numbered(script, "ev", source)
    script.add("cells", "SELECT DISTINCT user_id, item_id FROM ev_rows")
    found["interaction_matrix"] = script.select("SELECT * FROM cells")
    found["matrix_stats"] = script.select(
        "SELECT (SELECT count(*) FROM ev_users) AS num_users, (SELECT count(*) FROM ev_items) AS num_items, "
        "(SELECT count(*) FROM cells) AS nnz, round((SELECT count(*) FROM cells)::DOUBLE / "
        "((SELECT count(*) FROM ev_users)::DOUBLE * (SELECT count(*) FROM ev_items)::DOUBLE) * 100.0, 9) AS density_pct"
    )
    found["neighbour_lists"] = script.select(
        "SELECT user_id, CAST(item_id // 65536 AS INTEGER) AS part, "
        "string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM cells GROUP BY ALL"
    )
    split(script, "ev", "ev_rows")
    found["loo_train"] = script.select("SELECT * FROM ev_train")
    found["leakage_check"] = script.select(
        "SELECT count(*) AS leaked FROM ev_test JOIN ev_train USING (user_id, item_id)"
    )

    script = Script()
    prepared(script, "d", PURCHASES, 25.0, 10, 10, 0.5)
    found["prepare_summary"] = script.select(
        "SELECT (SELECT count(*) FROM d_users) AS num_users, (SELECT count(*) FROM d_items) AS num_items, "
        "(SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM d_rows)) AS full_nnz, "
        "(SELECT count(*) FROM d_train) AS train_nnz, (SELECT count(*) FROM d_test) AS test_users, "
        "(SELECT count(*) FROM d_test JOIN d_train USING (user_id, item_id)) AS leaked"
    )
    return found


def _sampled_matrix(script: Script, prefix: str, fraction: float) -> Script:
    """sub_users, sub_items and sub_train of a share of the matrix rows."""
    condition = sample_condition(f"{prefix}_users", "user_id", fraction)
    script.add("sub_kept", f"SELECT * FROM {prefix}_train WHERE {condition}")
    script.add(
        "sub_users",
        f"SELECT user_id AS old_user, row_number() OVER (ORDER BY user_id) - 1 AS user_id FROM {prefix}_users WHERE {condition}",
    )
    script.add(
        "sub_items",
        "SELECT item_id AS old_item, row_number() OVER (ORDER BY item_id) - 1 AS item_id FROM (SELECT DISTINCT item_id FROM sub_kept)",
    )
    script.add(
        "sub_train",
        "SELECT u.user_id, i.item_id FROM sub_kept k JOIN sub_users u ON u.old_user = k.user_id JOIN sub_items i ON i.old_item = k.item_id",
    )
    return script


def _base(rank: int = RANK, weights: str | None = None) -> Script:
    script = Script()
    prepared(script, "d", PURCHASES)
    start_factors(script, "d", rank, weights or popularity("d"))
    return script


def _gaussian(side: str, rank: int) -> str:
    def uniform(j: int, first: int) -> str:
        digest = f"md5(concat('42:{side}:', id, ':{j}'))"
        return f"CAST(CAST('0x' || substr({digest}, {first}, 13) AS BIGINT) AS DOUBLE)"

    values = []
    for f in range(rank):
        j, wave = f // 2, "cos" if f % 2 == 0 else "sin"
        radius = f"sqrt(-2.0::DOUBLE * ln(({uniform(j, 1)} + 1.0) / {float(2**52)}::DOUBLE))"
        angle = f"6.283185307179586::DOUBLE * ({uniform(j, 14)} / {float(2**52)}::DOUBLE)"
        values.append(f"round(0.01::DOUBLE * {radius} * {wave}({angle}), 9) AS f{f}")
    number = f"{side}_id"
    return f"SELECT '{side}' AS side, id, {', '.join(values)} FROM (SELECT {number} AS id FROM d_{side}s)"


def _factorisation() -> dict[str, str]:
    found = {}
    script = Script()
    prepared(script, "d", PURCHASES)
    found["item_weights"] = script.select(f"SELECT item_id, n, round(c, 9) AS c FROM ({popularity('d')})")
    found["init_factors"] = script.select(f"{_gaussian('user', 3)} UNION ALL {_gaussian('item', 3)}")

    cells = [(a, b) for a in range(RANK) for b in range(RANK)]

    def gram(table: str, scale: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {a} AS a, {b} AS b, round(sum({scale}f{a} * f{b}), 9) AS value FROM {table}" for a, b in cells
        )

    script = _base()
    found["gram_weighted"] = script.select(gram("d_q", "c * "))
    found["gram_plain"] = script.select(gram("d_p", ""))
    found["loss_eq7"] = script.select(f"SELECT round({loss('d_p', 'd_q', 'd_train', RANK)}, 6) AS loss")
    half_step(script, "new_p", "d_p", "d_q", "d_train", ("user_id", "item_id"), RANK, True, 1.0, 1.0)
    found["user_half_step"] = script.select(flat("new_p", "user"))
    script = _base()
    half_step(script, "new_q", "d_q", "d_p", "d_train", ("item_id", "user_id"), RANK, False, 1.0, 1.0)
    found["item_half_step"] = script.select(flat("new_q", "item"))

    script = _base()
    p, q = train(script, "d", RANK, ITERATIONS)[-1]
    found["eals_train"] = script.select(f"{flat(p, 'user')} UNION ALL {flat(q, 'item')}")

    script = _base(weights=constant("d", 1.0))
    found["loss_uniform"] = script.select(f"SELECT round({loss('d_p', 'd_q', 'd_train', RANK, 2.0)}, 6) AS loss")
    p, q = train(script, "d", RANK, ITERATIONS, 2.0, 0.5)[-1]
    found["eals_train_uniform"] = script.select(f"{flat(p, 'user')} UNION ALL {flat(q, 'item')}")
    return found


def _evaluation() -> dict[str, str]:
    found = {}
    script = _base()
    found["score_pairs"] = script.select(
        f"SELECT t.user_id, t.item_id, {dot(RANK, 'p', 'q')} AS score FROM d_test t "
        "JOIN d_p p ON p.id = t.user_id JOIN d_q q ON q.id = t.item_id"
    )
    users = "(SELECT id AS user_id FROM d_p)"
    found["recommend_topk"] = script.select(
        "SELECT user_id, position, candidate AS item_id, score FROM (SELECT *, CAST(row_number() OVER "
        "(PARTITION BY user_id ORDER BY score DESC, candidate) AS INTEGER) AS position "
        f"FROM ({candidates('d_p', 'd_q', 'd', RANK, users)})) WHERE position <= 10"
    )
    ranks(script, "placed", "d_p", "d_q", "d", RANK)
    found["test_item_rank"] = script.select("SELECT * FROM placed")
    found["rank_eval_10"] = script.select(f"SELECT {metrics((10,))} FROM placed")
    found["rank_eval_multi"] = script.select(f"SELECT {metrics((5, 10, 20))} FROM placed")
    return found


def _experiments() -> dict[str, str]:
    found = {}
    script = _base()
    rows = []
    for number, (p, q) in enumerate(train(script, "d", RANK, ITERATIONS), start=1):
        placed = ranks(script, f"placed_{number}", p, q, "d", RANK)
        value = loss(p, q, "d_train", RANK)
        rows.append(f"SELECT {number} AS iteration, round({value}, 4) AS loss, {metrics((5, 10, 20))} FROM {placed}")
    found["convergence"] = script.select(" UNION ALL ".join(rows))

    script, rows = Script(), []
    prepared(script, "d", PURCHASES)
    for rank in (2, 4):
        prefix = f"k{rank}"
        for table in ("users", "items", "train", "test"):
            script.add(f"{prefix}_{table}", f"SELECT * FROM d_{table}")
        start_factors(script, prefix, rank, popularity(prefix))
        p, q = train(script, prefix, rank, 1)[-1]
        placed = ranks(script, f"{prefix}_placed", p, q, prefix, rank)
        value = loss(p, q, "d_train", rank)
        rows.append(
            f"SELECT {rank} AS k, hr_5, hr_10, hr_20, ndcg_10, round({value}, 4) AS final_loss "
            f"FROM (SELECT {metrics((5, 10, 20), 4)} FROM {placed})"
        )
    found["k_sweep"] = script.select(" UNION ALL ".join(rows))

    script = _base()
    _sampled_matrix(script, "d", 0.25)
    start_factors(script, "sub", RANK, popularity("sub"))
    sub_p, sub_q = train(script, "sub", RANK, 1)[-1]
    p, q = train(script, "d", RANK, 1)[-1]
    placed = ranks(script, "placed", p, q, "d", RANK)

    def sizes(prefix: str) -> str:
        return (
            f"(SELECT count(*) FROM {prefix}_users) AS num_users, (SELECT count(*) FROM {prefix}_items) AS num_items, "
            f"(SELECT count(*) FROM {prefix}_train) AS train_nnz"
        )

    found["size_sweep"] = script.select(
        f"SELECT '25%' AS label, {sizes('sub')}, round({loss(sub_p, sub_q, 'sub_train', RANK)}, 4) AS final_loss, "
        f"NULL::DOUBLE AS hr_10 UNION ALL SELECT '100%' AS label, {sizes('d')}, "
        f"round({loss(p, q, 'd_train', RANK)}, 4) AS final_loss, "
        f"(SELECT hr_10 FROM (SELECT {metrics((10,), 4)} FROM {placed})) AS hr_10"
    )

    def sweep(runs: Sequence[tuple[str, str, float]]) -> str:
        script, rows = Script(), []
        for number, (name, source, fraction) in enumerate(runs):
            prefix = f"r{number}"
            prepared(script, prefix, source, 0.0, 5, 0, fraction)
            start_factors(script, prefix, RANK, constant(prefix, 1.0))
            p, q = train(script, prefix, RANK, 1, 2.0, 0.5)[-1]
            placed = ranks(script, f"{prefix}_placed", p, q, prefix, RANK)
            label = name if fraction >= 1.0 else f"{name}@{fraction:.0%}"
            value = loss(p, q, f"{prefix}_train", RANK, 2.0)
            rows.append(
                f"SELECT '{label}' AS label, '{name}' AS dataset, {fraction}::DOUBLE AS fraction, num_users, num_items, train_nnz, "
                "round(train_nnz::DOUBLE / (num_users * num_items)::DOUBLE * 100.0, 4) AS density_pct, "
                f"round({value}, 4) AS final_loss, m.* FROM (SELECT {sizes(prefix)}) "
                f"CROSS JOIN (SELECT {metrics((5, 10, 20))} FROM {placed}) m"
            )
        return script.select(" UNION ALL ".join(rows))

    found["dataset_sweep"] = sweep([("purchases", PURCHASES, 1.0), ("events", EVENTS, 1.0)])
    found["resplit_size_sweep"] = sweep([("purchases", PURCHASES, 0.25), ("purchases", PURCHASES, 0.5)])

    script = _base(weights=constant("d", 1.0))
    steps = train(script, "d", RANK, ITERATIONS, 2.0, 1.0)
    losses = [f"round({loss(p, q, 'd_train', RANK, 2.0)}, 4)" for p, q in steps]
    found["loss_parity"] = script.select(
        "SELECT iteration, loss AS loss_a, loss AS loss_b, true AS matches FROM ("
        + " UNION ALL ".join(f"SELECT {n} AS iteration, {value} AS loss" for n, value in enumerate(losses, start=1))
        + ")"
    )
    known = [f"SELECT DISTINCT '{side}' AS side, {side}_id AS id, 8 AS length, {solved} AS solved FROM d_train" for side, solved in (("user", "true"), ("item", "NULL::BOOLEAN"))]
    found["baseline_als"] = script.select(" UNION ALL ".join(known))
    solved = [f"SELECT DISTINCT '{side}' AS side, {side}_id AS id, 8 AS length, true AS solved FROM d_train" for side in ("user", "item")]
    found["implicit_als"] = script.select(" UNION ALL ".join(solved))
    every = [f"SELECT '{side}' AS side, {side}_id AS id, 8 AS length FROM d_{side}s" for side in ("user", "item")]
    found["baseline_factors"] = script.select(" UNION ALL ".join(every))
    found["baseline_comparison"] = "SELECT method, true AS growing, true AS inside FROM (VALUES ('elementwise'), ('mllib')) v(method)"
    placed = ranks(script, "placed", *steps[-1], "d", RANK)
    found["trainer_comparison"] = script.select(
        f"SELECT implementation, {losses[-1]} AS final_loss, hr_10 FROM (SELECT {metrics((10,))} FROM {placed}) "
        "CROSS JOIN (VALUES ('uniform'), ('popularity')) v(implementation)"
    )
    return found

"""Independent SQL text (DuckDB dialect) for every registered query.

Each query is a chain of materialised CTEs over the driver's views
(orders, lineitem, documents, events, ...). The EM passes are unrolled into
CTEs, wide form, with the same left-to-right arithmetic as the Spark plans;
all-pairs quantities use a plain cross join of the (small) user and item
parameter tables, which is fine for an oracle at sf0.01. Doubles are
compared as ``floor(x * 10^d + 0.5)`` fingerprints: d = 9 for tiny or
bit-identical values, d = 6 for O(0.1..1e5) sums (see ``q6`` in
latentcf.plans.queries).
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see latentcf.plans.queries).
TWO32 = "CAST(4294967296 AS DOUBLE)"
TWO32P1 = "CAST(4294967297 AS DOUBLE)"
FLOOR = "CAST(1e-300 AS DOUBLE)"


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def qz(expr: str, digits: int = 9) -> str:
    """The fingerprint of a double: floor(x * 10^digits + 0.5) as bigint."""
    return f"CAST(floor(({expr}) * CAST({10 ** digits} AS DOUBLE) + 0.5) AS BIGINT)"


def bits(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def unit_open(*parts: str) -> str:
    return f"(({bits(*parts)} + 1) / {TWO32P1})"


def unit_half_open(*parts: str) -> str:
    return f"({bits(*parts)} / {TWO32})"


def rsum(terms: list[str]) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


class Chain:
    """An ordered list of CTEs rendered as one WITH clause."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []

    def add(self, name: str, sql: str) -> str:
        self.ctes.append((name, sql))
        return name

    def sql(self, final: str) -> str:
        body = ",\n".join(f"{n} AS MATERIALIZED (\n{s}\n)" for n, s in self.ctes)
        return f"WITH {body}\n{final}"


# ---------------------------------------------------------------- inputs


def purchase_rows(ch: Chain) -> str:
    return ch.add("rows_", "SELECT o_custkey AS u, l_partkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey "
                           "WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL")


def purchase_pairs(ch: Chain) -> str:
    r = purchase_rows(ch)
    return ch.add("pairs", f"SELECT DISTINCT u, s FROM {r}")


def weighted_pairs(ch: Chain) -> str:
    r = purchase_rows(ch)
    return ch.add("wpairs", f"SELECT u, s, count(*) AS w FROM {r} GROUP BY u, s")


def word_pairs(ch: Chain) -> str:
    return ch.add(
        "wordpairs",
        "SELECT DISTINCT u, s FROM (SELECT doc_id AS u, unnest(regexp_extract_all(lower(text), '\\p{L}+', 0)) AS s "
        "FROM documents) t WHERE u IS NOT NULL AND length(s) > 0",
    )


def event_pairs(ch: Chain) -> str:
    return ch.add("eventpairs", "SELECT DISTINCT user_id AS u, event_type AS s FROM events "
                                "WHERE user_id IS NOT NULL AND event_type IS NOT NULL")


def split(ch: Chain, pairs: str, alpha: float, seed: int) -> tuple[str, str, str]:
    """(train, test, raw test) CTE names."""
    h = ch.add("hsplit", f"SELECT u, s, {unit_half_open('u', 's', str(seed))} AS x FROM {pairs}")
    tr = ch.add("train", f"SELECT u, s FROM {h} WHERE x >= {dbl(alpha)}")
    te0 = ch.add("test_raw", f"SELECT u, s FROM {h} WHERE x < {dbl(alpha)}")
    te = ch.add("test", f"SELECT u, s FROM {te0} WHERE u IN (SELECT u FROM {tr}) AND s IN (SELECT s FROM {tr})")
    return tr, te, te0


# ---------------------------------------------------------------- EM (wide)


def init_q(ch: Chain, pairs: str, k: int, seed: int, tag: str, wcol: str | None = None) -> str:
    cols = ", ".join(f"{unit_open('u', 's', str(z), str(seed))} AS q{z}" for z in range(k))
    extra = f", {wcol}" if wcol else ""
    return ch.add(f"q0_{tag}", f"SELECT u, s{extra}, {cols} FROM {pairs}")


def m_step(ch: Chain, q: str, k: int, tag: str, wcol: str | None = None, alpha: float = 0.0,
           eta: float = 0.0) -> tuple[str, str, str, str]:
    """-> (user mass, item counts, p(z|u) table pu, p(s|z) table ps); pseudo-counts alpha, eta."""
    wq = [f"q{z} * {wcol}" if wcol else f"q{z}" for z in range(k)]
    um = ch.add(f"um_{tag}", f"SELECT u, {', '.join(f'sum({x}) AS m{z}' for z, x in enumerate(wq))} FROM {q} GROUP BY u")
    sm = ch.add(f"sm_{tag}", f"SELECT s, {', '.join(f'sum({x}) AS m{z}' for z, x in enumerate(wq))} FROM {q} GROUP BY s")
    nz = ch.add(f"nz_{tag}", f"SELECT {', '.join(f'sum(m{z}) AS n{z}' for z in range(k))}, count(*) AS n_items FROM {sm}")
    um_z = [f"(m{z} + {dbl(alpha)})" if alpha else f"m{z}" for z in range(k)]
    sm_z = [f"(m{z} + {dbl(eta)}) / (n{z} + n_items * {dbl(eta)})" if eta else f"m{z} / n{z}" for z in range(k)]
    tot = rsum(um_z)
    pu = ch.add(f"pu_{tag}", f"SELECT u, {', '.join(f'{um_z[z]} / {tot} AS pu{z}' for z in range(k))} FROM {um}")
    ps = ch.add(f"ps_{tag}", f"SELECT s, {', '.join(f'{sm_z[z]} AS ps{z}' for z in range(k))} FROM {sm}, {nz}")
    return um, sm, pu, ps


def e_step(ch: Chain, pairs: str, pu: str, ps: str, k: int, tag: str, wcol: str | None = None) -> str:
    """-> table (u, s, [w], w0.., evidence, q0..)."""
    extra = f", p.{wcol}" if wcol else ""
    ws = ", ".join(f"a.pu{z} * b.ps{z} AS w{z}" for z in range(k))
    j = ch.add(f"ew_{tag}", f"SELECT p.u, p.s{extra}, {ws} FROM {pairs} p JOIN {pu} a ON p.u = a.u JOIN {ps} b ON p.s = b.s")
    ev = f"greatest({rsum([f'w{z}' for z in range(k)])}, {FLOOR})"
    e = ch.add(f"ee_{tag}", f"SELECT *, {ev} AS evidence FROM {j}")
    qs = ", ".join(f"w{z} / evidence AS q{z}" for z in range(k))
    return ch.add(f"eq_{tag}", f"SELECT *, {qs} FROM {e}")


def loglik_of(eq: str, wcol: str | None = None) -> str:
    if wcol:
        return f"(SELECT sum(ln(evidence) * {wcol}) / sum({wcol}) FROM {eq})"
    return f"(SELECT avg(ln(evidence)) FROM {eq})"


def em(ch: Chain, pairs: str, k: int, passes: int, seed: int, tag: str = "", wcol: str | None = None,
       alpha: float = 0.0, eta: float = 0.0):
    """Unrolled EM: returns (pu, ps, [loglik scalar subqueries per pass])."""
    q = init_q(ch, pairs, k, seed, f"{tag}0", wcol)
    _, _, pu, ps = m_step(ch, q, k, f"{tag}1", wcol, alpha, eta)
    lls = []
    for t in range(1, passes + 1):
        eq = e_step(ch, pairs, pu, ps, k, f"{tag}{t}", wcol)
        lls.append(loglik_of(eq, wcol))
        if t < passes:
            _, _, pu, ps = m_step(ch, eq, k, f"{tag}{t + 1}", wcol, alpha, eta)
    return pu, ps, lls


def trace_sql(lls: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS iteration, {qz(x, 6)} AS loglik_q"
                              for i, x in enumerate(lls))


def all_scores(ch: Chain, pu: str, ps: str, k: int, tag: str = "") -> str:
    sc = rsum([f"a.pu{z} * b.ps{z}" for z in range(k)])
    return ch.add(f"allsc{tag}", f"SELECT a.u, b.s, {sc} AS score FROM {pu} a CROSS JOIN {ps} b")


def pair_scores(ch: Chain, pairs: str, pu: str, ps: str, k: int, name: str) -> str:
    sc = rsum([f"a.pu{z} * b.ps{z}" for z in range(k)])
    return ch.add(name, f"SELECT p.u, p.s, {sc} AS score FROM {pairs} p JOIN {pu} a ON p.u = a.u JOIN {ps} b ON p.s = b.s")


def confusion(ch: Chain, allsc: str, train: str, test: str, thresholds: list[float], inclusive: bool,
              truth: str, name: str) -> str:
    """(threshold, tp, fp, fn, tn) by brute force over every user x item pair."""
    op = ">=" if inclusive else ">"
    ths = ch.add(f"ths_{name}", " UNION ALL ".join(f"SELECT {dbl(t)} AS threshold" for t in thresholds))
    if truth == "test":
        lab = ch.add(
            f"lab_{name}",
            f"SELECT a.u, a.s, a.score, (t.u IS NOT NULL) AS truth FROM {allsc} a "
            f"LEFT JOIN {test} t ON a.u = t.u AND a.s = t.s "
            f"WHERE NOT EXISTS (SELECT 1 FROM {train} r WHERE r.u = a.u AND r.s = a.s)",
        )
    else:
        lab = ch.add(
            f"lab_{name}",
            f"SELECT a.u, a.s, a.score, (r.u IS NOT NULL) AS truth FROM {allsc} a "
            f"LEFT JOIN {train} r ON a.u = r.u AND a.s = r.s",
        )
    return ch.add(
        name,
        f"SELECT h.threshold, "
        f"CAST(count(*) FILTER (WHERE l.score {op} h.threshold AND l.truth) AS BIGINT) AS tp, "
        f"CAST(count(*) FILTER (WHERE l.score {op} h.threshold AND NOT l.truth) AS BIGINT) AS fp, "
        f"CAST(count(*) FILTER (WHERE NOT (l.score {op} h.threshold) AND l.truth) AS BIGINT) AS fn, "
        f"CAST(count(*) FILTER (WHERE NOT (l.score {op} h.threshold) AND NOT l.truth) AS BIGINT) AS tn "
        f"FROM {ths} h CROSS JOIN {lab} l GROUP BY h.threshold",
    )


def rates(conf: str) -> str:
    """precision, recall, f1 (NULL on 0/0) over a confusion CTE."""
    p = "CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END"
    r = "CASE WHEN tp + fn = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END"
    return (f"SELECT *, CASE WHEN precision IS NULL OR recall IS NULL OR precision + recall = 0 THEN NULL "
            f"ELSE 2.0 * precision * recall / (precision + recall) END AS f1 "
            f"FROM (SELECT *, {p} AS precision, {r} AS recall FROM {conf})")

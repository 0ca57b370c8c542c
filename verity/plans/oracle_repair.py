"""DuckDB SQL for the full repair pipeline over a dirty view.

Built from the view's static schema and the name-derived column roles; every
data-dependent decision (currency share, dominant date shape, boolean
vocabulary, naming pattern, median, mode, casing) is computed by DuckDB.
Each rule is a pair of CTEs: the new state and the change rows it emitted.
"""

from __future__ import annotations

from ..functions.constants import (BOOLEAN_FALSE, BOOLEAN_TRUE, CURRENCY_PATTERN, DATE_FORMATS,
                                   DOMAIN_FIXES, EMAIL_PATTERN, NAME_PARTICLES, NULL_SENTINELS,
                                   RATING_LABELS, RATING_NAME_WORDS, RATING_WORDS, TO_BE_DETERMINED)
from ..functions.numeric import DECIMAL_TEXT
from ..functions.roles import column_role
from .oracle_inspect import VIEW_COLUMNS, ident, q
from .views_sql import VIEW_SQL

WS = r"^\s+|\s+$"
_D = r"[0-9](_?[0-9])*"
PY_DEC = r"^[+-]?((" + _D + r")(\.(" + _D + r")?)?|\.(" + _D + r"))([eE][+-]?" + _D + r")?$"
PY_SPECIAL = [s + w for s in ("", "+", "-") for w in ("inf", "infinity", "nan")]
STRFTIME = {0: "%Y-%m-%d", 1: "%m/%d/%Y", 2: "%m-%d-%Y", 3: "%d.%m.%Y", 4: "%Y/%m/%d"}
PATTERNS = ("first.last", "first.linit", "finit.last", "last.first", "last.finit", "first")


def inlist(vals) -> str:
    return ", ".join(q(v) for v in vals)


def strip(x):
    return f"regexp_replace({x}, {q(WS)}, '', 'g')"


def py_float(x):
    return f"(regexp_matches({x}, {q(PY_DEC)}) OR lower({x}) IN ({inlist(PY_SPECIAL)}))"


def py_float_value(x):
    return f"(CASE WHEN {py_float(x)} THEN TRY_CAST(replace({x}, '_', '') AS DOUBLE) END)"


def castable_float(x):
    y = f"replace({strip(x)}, ',', '')"
    return f"coalesce({py_float(y)}, FALSE)"


def rating_number(vl):
    whens = " ".join(f"WHEN contains({vl}, {q(w)}) THEN {q(str(n))}" for w, n in RATING_WORDS)
    return f"(CASE {whens} END)"


def is_rating_word(vl):
    return f"({vl} IN ({inlist(w for w, _ in RATING_WORDS)}))"


def rating_label(x):
    whens = " ".join(f"WHEN {x} <= {(v0 + v1) / 2} THEN {q(l0)}"
                     for (v0, l0), (v1, _) in zip(RATING_LABELS, RATING_LABELS[1:]))
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR isinf({x}) THEN 'Average' {whens} "
            f"ELSE {q(RATING_LABELS[-1][1])} END)")


def decimal_value(x):
    return f"(CASE WHEN regexp_matches({x}, {q(DECIMAL_TEXT)}) THEN CAST({x} AS DOUBLE) END)"


def date_shape(x):
    whens = " ".join(f"WHEN regexp_matches({x}, {q(rx)}) THEN {i}" for i, (rx, _p, _s) in enumerate(DATE_FORMATS))
    return f"(CASE {whens} END)"


def parse(x, i):
    return f"strftime(try_strptime({x}, {q(STRFTIME[i])}), '%Y-%m-%d')"


def email_norm(x):
    f = f"lower({strip(x)})"
    dom = f"regexp_extract({f}, '@([^@]*)$', 1)"
    fixes = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in DOMAIN_FIXES)
    return (f"(CASE WHEN contains({f}, '@') THEN left({f}, length({f}) - length({dom}) - 1) || '@' || "
            f"(CASE {dom} {fixes} ELSE {dom} END) ELSE {f} END)")


def phone(x):
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (f"(CASE WHEN length({d}) = 10 THEN '(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || "
            f"substr({d}, 7, 4) WHEN length({d}) = 11 AND substr({d}, 1, 1) = '1' THEN '+1 (' || substr({d}, 2, 3)"
            f" || ') ' || substr({d}, 5, 3) || '-' || substr({d}, 8, 4) END)")


def words(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def smart_title(x):
    return (f"array_to_string(list_transform({words(x)}, lambda w, i: CASE WHEN i > 1 AND lower(w) IN "
            f"({inlist(NAME_PARTICLES)}) THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ')")


def lower_style(x):
    return f"({x} = lower({x}) AND {x} <> upper({x}))"


def upper_style(x):
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def title_style(x):
    from .oracle_inspect import NOT_TITLE
    return f"(NOT regexp_matches({x}, {q(NOT_TITLE)}))"


def present(x):
    return f"({x} IS NOT NULL AND {x} <> '')"


def valid_email(x):
    return f"regexp_matches({x}, {q(EMAIL_PATTERN)})"


class RepairSQL:
    def __init__(self, view: str):
        self.view = view
        self.cols = VIEW_COLUMNS[view]
        self.names = [c for c, _ in self.cols]
        self.roles = {c: column_role(c) for c in self.names}
        self.ctes = []
        self.changes = []   # CTE names holding change rows
        self.quar = []      # CTE names holding quarantine rows
        self.k = 0

    # -- step machinery ----------------------------------------------------
    def add(self, name, sql, materialized: bool = False):
        m = "MATERIALIZED " if materialized else ""
        self.ctes.append(f"{name} AS {m}({sql})")

    def step(self, rule: int, branches: dict, src_from: str | None = None) -> None:
        """branches: col -> [(cond, new or None, kind_sql, reason_sql, assign, quarantine)]."""
        prev = f"s{self.k}"
        self.k += 1
        cur = f"s{self.k}"
        frm = src_from or prev
        sel = ["_row_id"]
        chg, qr = [], []
        for ci, c in enumerate(self.names):
            x = ident(c)
            bs = branches.get(c, [])
            assigns = [(b[0], b[1]) for b in bs if b[4]]
            if assigns:
                whens = " ".join(f"WHEN {cond} THEN {new if new is not None else 'NULL'}" for cond, new in assigns)
                sel.append(f"CAST(CASE {whens} ELSE {x} END AS VARCHAR) AS {x}")
            else:
                sel.append(x)
            earlier = []
            for cond, new, kind, reason, _assign, quar in bs:
                guard = " AND ".join([f"({cond})"] + [f"NOT coalesce(({e}), FALSE)" for e in earlier])
                nv = f"coalesce(CAST({new} AS VARCHAR), '')" if new is not None else "''"
                chg.append(f"SELECT _row_id, {rule} AS rule, {ci} AS col, {q(c)} AS \"column\", "
                           f"coalesce({x}, '') AS old_value, {nv} AS new_value, {kind} AS kind, "
                           f"{reason} AS reason FROM {frm} WHERE {guard}")
                if quar:
                    qr.append(f"SELECT _row_id, {rule} AS rule, {ci} AS col, {reason} AS reason "
                              f"FROM {frm} WHERE {guard}")
                earlier.append(cond)
        self.add(cur, f"SELECT {', '.join(sel)} FROM {frm}", materialized=True)
        if chg:
            self.add(f"c{self.k}", " UNION ALL ".join(chg))
            self.changes.append(f"c{self.k}")
        if qr:
            self.add(f"q{self.k}", " UNION ALL ".join(qr))
            self.quar.append(f"q{self.k}")

    # -- the pipeline -------------------------------------------------------
    def build(self):
        cast = ", ".join(f"CAST({ident(c)} AS VARCHAR) AS {ident(c)}" for c in self.names)
        self.ctes.append(f"{self.view} AS ({VIEW_SQL[self.view]}\n)")
        self.add("s0", f"SELECT CAST(_row_id AS BIGINT) AS _row_id, {cast} FROM {self.view}")
        # F1
        self.step(1, {c: [(f"{ident(c)} IS NOT NULL AND {ident(c)} <> {strip(ident(c))}", strip(ident(c)),
                           "'fixed'", q("Leading/trailing whitespace stripped."), True, False)]
                      for c in self.names})
        # F2
        self.step(2, {c: [(f"{ident(c)} IS NOT NULL AND lower({strip(ident(c))}) IN ({inlist(NULL_SENTINELS)})",
                           None, "'fixed'", f"'Null-sentinel ''' || {ident(c)} || ''' normalised to null.'",
                           True, False)] for c in self.names})
        after_f2 = f"s{self.k}"
        # B1: F3 + F5/F6 statistics
        skip = {"id", "email", "phone", "date", "name"}
        rating_cols = [c for c in self.names if self.roles[c] == "critical"
                       and any(k in c.lower() for k in RATING_NAME_WORDS)]
        currx = CURRENCY_PATTERN

        def cur_hit(x):
            return f"regexp_matches({strip(x)}, {q(currx)})"

        def cur_clean(x):
            return f"replace(regexp_extract({strip(x)}, {q(currx)}, 1), ',', '')"

        def after_rating(c, x):
            if c not in rating_cols:
                return x
            vl = f"lower({strip(x)})"
            num = py_float_value(vl)
            return (f"(CASE WHEN {x} IS NOT NULL AND {rating_number(vl)} IS NOT NULL THEN {rating_number(vl)} "
                    f"WHEN {x} IS NOT NULL AND {num} > 5.0 AND NOT isnan({num}) THEN '5.0' "
                    f"WHEN {x} IS NOT NULL AND {num} < 0.0 AND NOT isnan({num}) THEN '1.0' ELSE {x} END)")

        parts = []
        for i, c in enumerate(self.names):
            x = ident(c)
            parts.append(f"count({x}) AS nn_{i}")
            if self.roles[c] not in skip:
                parts.append(f"count_if({x} IS NOT NULL AND {cur_hit(x)}) AS cur_{i}")
            for variant in ("raw", "f3"):
                if variant == "f3" and self.roles[c] in skip:
                    continue
                base = x if variant == "raw" else f"(CASE WHEN {x} IS NOT NULL AND {cur_hit(x)} THEN {cur_clean(x)} ELSE {x} END)"
                y = after_rating(c, base)
                parts.append(f"count_if({y} IS NOT NULL AND {castable_float(y)}) AS num_{variant}_{i}")
                parts.append(f"count_if({y} IS NOT NULL AND {is_rating_word(f'lower({strip(y)})')}) AS txt_{variant}_{i}")
        self.add("b1", f"SELECT {', '.join(parts)} FROM {after_f2}")
        dec = []
        for i, c in enumerate(self.names):
            f3 = (f"(nn_{i} >= 3 AND cur_{i} / nn_{i} >= 0.5)" if self.roles[c] not in skip else "FALSE")
            num = f"(CASE WHEN {f3} THEN num_f3_{i} ELSE num_raw_{i} END)" if self.roles[c] not in skip else f"num_raw_{i}"
            txt = f"(CASE WHEN {f3} THEN txt_f3_{i} ELSE txt_raw_{i} END)" if self.roles[c] not in skip else f"txt_raw_{i}"
            lab = f"(nn_{i} >= 2 AND {txt} / nn_{i} > 0.5 AND {num} > 0 AND {num} / nn_{i} < 0.5)"
            numr = f"(nn_{i} >= 2 AND NOT {lab} AND {num} / nn_{i} > 0.5 AND {txt} > 0 AND {txt} / nn_{i} < 0.5)"
            dec += [f"{f3} AS f3_{i}", f"{lab} AS lab_{i}", f"{numr} AS tonum_{i}"]
        self.add("d1", f"SELECT {', '.join(dec)} FROM b1")

        def d(name):
            return f"(SELECT {name} FROM d1)"

        # F3
        br = {}
        for i, c in enumerate(self.names):
            if self.roles[c] in skip:
                continue
            x = ident(c)
            br[c] = [(f"{d(f'f3_{i}')} AND {x} IS NOT NULL AND {cur_hit(x)} AND {cur_clean(x)} <> {strip(x)}",
                      cur_clean(x), "'fixed'", q("Currency symbol / thousand-separator removed."), True, False)]
        self.step(3, br)
        # F4
        br = {}
        for c in rating_cols:
            x = ident(c)
            vl = f"lower({strip(x)})"
            word = rating_number(vl)
            num = py_float_value(vl)
            br[c] = [(f"{x} IS NOT NULL AND {word} IS NOT NULL", word, "'fixed'",
                      f"'Text rating ''' || {x} || ''' → ' || {word} || '.'", True, False),
                     (f"{x} IS NOT NULL AND {num} > 5.0 AND NOT isnan({num})", "'5.0'", "'fixed'",
                      f"'Rating ' || {x} || ' > max 5 — clamped.'", True, False),
                     (f"{x} IS NOT NULL AND {num} < 0.0 AND NOT isnan({num})", "'1.0'", "'fixed'",
                      f"'Negative rating ' || {x} || ' clamped to 1.0.'", True, False)]
        self.step(4, br)
        # F5 / F6
        br = {}
        for i, c in enumerate(self.names):
            x = ident(c)
            sv = strip(x)
            vl = f"lower({sv})"
            label = rating_label(py_float_value(sv))
            word = rating_number(vl)
            br[c] = [(f"{d(f'lab_{i}')} AND {x} IS NOT NULL AND {castable_float(x)} AND NOT {is_rating_word(vl)} "
                      f"AND {py_float(sv)}", label, "'fixed'",
                      f"'Numeric ' || {x} || ' in text-rating column → ''' || {label} || '''.'", True, False),
                     (f"{d(f'tonum_{i}')} AND {x} IS NOT NULL AND {word} IS NOT NULL", word, "'fixed'",
                      f"'Text label ''' || {x} || ''' in numeric column → ' || {word} || '.'", True, False)]
        self.step(5, br)
        after_f6 = f"s{self.k}"
        # Date shapes and booleans
        date_cols = [c for c in self.names if self.roles[c] == "date"]
        ds = []
        for i, c in enumerate(self.names):
            if c not in date_cols:
                continue
            x = ident(c)
            for f in range(len(DATE_FORMATS)):
                ds.append(f"SELECT {i} AS ci, {f} AS fmt, count(*) AS cnt, min(_row_id) AS fr FROM {after_f6} "
                          f"WHERE {x} IS NOT NULL AND {date_shape(strip(x))} = {f}")
        if ds:
            self.add("dsh", " UNION ALL ".join(ds))
            self.add("ddom", "SELECT ci, first(fmt ORDER BY cnt DESC, fr ASC) AS dom FROM dsh WHERE cnt > 0 "
                             "GROUP BY ci")
        words_all = inlist(list(BOOLEAN_TRUE) + list(BOOLEAN_FALSE))
        bparts = []
        for i, c in enumerate(self.names):
            x = ident(c)
            vl = f"lower({strip(x)})"
            ne = f"({x} IS NOT NULL AND {x} <> '')"
            bparts.append(f"(count({x}) >= 2 AND coalesce(bool_and(CASE WHEN {ne} THEN {vl} IN ({words_all}) END), "
                          f"TRUE) AND min(CASE WHEN {ne} THEN {vl} END) IS NOT NULL AND "
                          f"min(CASE WHEN {ne} THEN {vl} END) <> max(CASE WHEN {ne} THEN {vl} END)) AS bool_{i}")
        self.add("b3", f"SELECT {', '.join(bparts)} FROM {after_f6}")
        # F7
        br = {}
        for i, c in enumerate(self.names):
            if c not in date_cols:
                continue
            x = ident(c)
            vs = strip(x)
            dom = f"(SELECT dom FROM ddom WHERE ci = {i})"
            first = "(CASE " + " ".join(f"WHEN {dom} = {f} THEN {parse(vs, f)}" for f in range(5)) + " END)"
            other = "coalesce(" + ", ".join(parse(vs, f) for f in range(5)) + ")"
            active = f"coalesce({dom} <> 0, FALSE)"
            reason = q("Date standardised to ISO 8601.")
            br[c] = [(f"{active} AND {x} IS NOT NULL AND {first} IS NOT NULL AND {first} <> {vs}", first,
                      "'fixed'", reason, True, False),
                     (f"{active} AND {x} IS NOT NULL AND {first} IS NULL AND {other} IS NOT NULL", other,
                      "'fixed'", reason, True, False)]
        self.step(6, br)
        # F8
        br = {}
        for c in self.names:
            if self.roles[c] != "email":
                continue
            x = ident(c)
            nv = email_norm(x)
            br[c] = [(f"{x} IS NOT NULL AND {nv} <> {x}", nv, "'fixed'",
                      q("Email normalised (lowercase + domain correction)."), True, False)]
        self.step(7, br)
        # F9
        br = {}
        for c in self.names:
            if self.roles[c] != "phone":
                continue
            x = ident(c)
            fmt = phone(x)
            br[c] = [(f"{x} IS NOT NULL AND {fmt} IS NOT NULL AND {fmt} <> {strip(x)}", fmt, "'fixed'",
                      q("Phone number standardised."), True, False)]
        self.step(8, br)
        # F10
        br = {}
        for i, c in enumerate(self.names):
            x = ident(c)
            vl = f"lower({strip(x)})"
            on = f"(SELECT bool_{i} FROM b3)"
            br[c] = [(f"{on} AND {x} IS NOT NULL AND {vl} IN ({inlist(BOOLEAN_TRUE)}) AND {x} <> 'True'", "'True'",
                      "'fixed'", q("Boolean normalised to 'True'."), True, False),
                     (f"{on} AND {x} IS NOT NULL AND {vl} IN ({inlist(BOOLEAN_FALSE)}) AND {x} <> 'False'",
                      "'False'", "'fixed'", q("Boolean normalised to 'False'."), True, False)]
        self.step(9, br)
        # F11 / F12
        ecols = [c for c in self.names if self.roles[c] == "email"]
        ncols = [c for c in self.names if self.roles[c] == "name"]
        for pi, (ec, nc) in enumerate((a, b) for a in ecols for b in ncols):
            self.cross(pi, ec, nc)
        # B5 + F13-F17
        self.missing_and_casing()
        # F18
        br = {}
        for c in self.names:
            if self.roles[c] != "email":
                continue
            x = ident(c)
            reason = f"'Email ''' || {x} || ''' in ''{c}'' remains invalid after auto-correction — manual fix required.'"
            br[c] = [(f"{x} IS NOT NULL AND NOT {valid_email(strip(x))}", None, "'critical'", reason, False, True)]
        self.step(13, br)

    def cross(self, pi: int, ec: str, nc: str):
        src = f"s{self.k}"
        e, n = ident(ec), ident(nc)
        t = f"x{pi}_"
        dom_of = f"regexp_extract({e}, '@([^@]*)$', 1)"
        prefix = f"regexp_replace(lower(left({e}, length({e}) - length({dom_of}) - 1)), '^\\.+|\\.+$', '', 'g')"
        parts = words(f"replace({n}, ',', ' ')")
        self.add(f"{t}pairs", f"SELECT _row_id, {prefix} AS prefix, {dom_of} AS dom, {parts} AS parts FROM {src} "
                              f"WHERE {present(e)} AND {present(n)} AND contains({e}, '@') AND {valid_email(e)}")
        cand = []
        for o, (a, b) in enumerate((("lower(parts[1])", "lower(parts[-1])"), ("lower(parts[-1])", "lower(parts[1])"))):
            f, l = a, b
            cs = [f"{f} || '.' || {l}", f"{f} || '.' || left({l}, 1)", f"left({f}, 1) || '.' || {l}",
                  f"{l} || '.' || {f}", f"{l} || '.' || left({f}, 1)", f]
            for p, cexpr in enumerate(cs):
                cand.append(f"SELECT _row_id, {o} AS o, {p} AS p FROM {t}pairs WHERE len(parts) >= 2 AND "
                            f"prefix = {cexpr}")
        self.add(f"{t}votes", f"SELECT o, p, count(*) AS v, min(_row_id) AS fr FROM ({' UNION ALL '.join(cand)}) "
                              f"GROUP BY o, p")
        self.add(f"{t}pat", f"SELECT o, p, v, v / (SELECT sum(v) FROM {t}votes) AS conf, "
                            f"(SELECT arg_min(dom, _row_id) FROM {t}pairs) AS dom FROM {t}votes "
                            f"WHERE (SELECT count(*) FROM {t}pairs) >= 3 "
                            f"ORDER BY v DESC, fr, o, p LIMIT 1")
        self.add(f"{t}ok", f"SELECT * FROM {t}pat WHERE v >= 2 AND conf >= 0.5")
        # inferred e-mail per row
        nparts = words(f"replace({n}, ',', ' ')")
        a, b = f"lower({nparts}[1])", f"lower({nparts}[-1])"
        fl = f"(CASE WHEN (SELECT o FROM {t}ok) = 0 THEN {a} ELSE {b} END)"
        ll = f"(CASE WHEN (SELECT o FROM {t}ok) = 0 THEN {b} ELSE {a} END)"
        cs = [f"{fl} || '.' || {ll}", f"{fl} || '.' || left({ll}, 1)", f"left({fl}, 1) || '.' || {ll}",
              f"{ll} || '.' || {fl}", f"{ll} || '.' || left({fl}, 1)", fl]
        pfx = "(CASE (SELECT p FROM " + t + "ok) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cs)) + " END)"
        inferred = f"(CASE WHEN len({nparts}) >= 2 THEN {pfx} || '@' || (SELECT dom FROM {t}ok) END)"
        self.add(f"{t}cand", f"SELECT _row_id, {inferred} AS inf FROM {src} WHERE EXISTS (SELECT 1 FROM {t}ok) AND "
                             f"NOT {present(e)} AND {present(n)}")
        self.add(f"{t}win", f"SELECT min(_row_id) AS _row_id, inf FROM {t}cand WHERE inf IS NOT NULL AND "
                            f"{valid_email('inf')} AND inf NOT IN (SELECT {e} FROM {src} WHERE {present(e)} AND "
                            f"contains({e}, '@') AND {valid_email(e)}) GROUP BY inf")
        self.add(f"{t}src", f"SELECT {src}.*, {t}win.inf AS _inf FROM {src} LEFT JOIN {t}win USING (_row_id)")
        pct = f"printf('%.0f', (SELECT conf FROM {t}ok) * 100) || '%'"
        pat = "(CASE (SELECT p FROM " + t + "ok) " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(PATTERNS)) + " END)"
        tail = f"' (pattern: ' || {pat} || ', confidence: ' || {pct} || ').'"
        kind = f"(CASE WHEN (SELECT conf FROM {t}ok) >= 0.8 THEN 'fixed' ELSE 'warning' END)"
        br = {ec: [("_inf IS NOT NULL", "_inf", kind, f"'Email inferred from name ''' || {n} || '''' || {tail}",
                    True, False)]}
        # name from e-mail: only first.last (p=0) and last.first (p=3) yield both halves
        pre = f"regexp_replace(lower(left({e}, length({e}) - length({dom_of}) - 1)), '^\\.+|\\.+$', '', 'g')"
        ha = f"split_part({pre}, '.', 1)"
        hb = f"substr({pre}, length({ha}) + 2)"
        cap = lambda x: f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"
        first = f"(CASE WHEN (SELECT p FROM {t}ok) = 0 THEN {ha} ELSE {hb} END)"
        last = f"(CASE WHEN (SELECT p FROM {t}ok) = 0 THEN {hb} ELSE {ha} END)"
        full = (f"(CASE WHEN (SELECT o FROM {t}ok) = 0 THEN {cap(first)} || ' ' || {cap(last)} "
                f"ELSE {cap(last)} || ' ' || {cap(first)} END)")
        ok = (f"EXISTS (SELECT 1 FROM {t}ok WHERE p IN (0, 3)) AND _inf IS NULL AND NOT {present(n)} AND "
              f"{present(e)} AND {valid_email(e)} AND contains({e}, '@') AND contains({pre}, '.') AND "
              f"length({ha}) > 0 AND length({hb}) > 0")
        br[nc] = [(ok, full, kind, f"'Name inferred from email ''' || {e} || '''' || {tail}", True, False)]
        self.step(10, br, src_from=f"{t}src")

    def missing_and_casing(self):
        src = f"s{self.k}"
        parts = ["count(*) AS n"]
        for i, c in enumerate(self.names):
            x = ident(c)
            dv = decimal_value(x)
            parts += [f"count({x}) AS nn_{i}", f"count({dv}) AS num_{i}",
                      f"coalesce(bool_and(CASE WHEN {dv} IS NOT NULL THEN NOT isnan({dv}) AND NOT isinf({dv}) END), TRUE) AS fin_{i}",
                      f"coalesce(bool_and(CASE WHEN {dv} IS NOT NULL THEN {dv} = floor({dv}) END), TRUE) AS int_{i}",
                      f"median({dv}) AS med_{i}",
                      f"count_if({x} IS NOT NULL AND {lower_style(x)}) AS lo_{i}",
                      f"count_if({x} IS NOT NULL AND {upper_style(x)}) AS up_{i}",
                      f"count_if({x} IS NOT NULL AND {title_style(x)}) AS ti_{i}"]
        self.add("b5", f"SELECT {', '.join(parts)} FROM {src}")
        modes = []
        for i, c in enumerate(self.names):
            x = ident(c)
            modes.append(f"SELECT {i} AS ci, mv, mc FROM (SELECT {x} AS mv, count(*) AS mc FROM {src} WHERE {x} IS NOT NULL "
                         f"GROUP BY {x} ORDER BY mc DESC, mv ASC LIMIT 1)")
        self.add("md", " UNION ALL ".join(modes))
        qroles = ("id", "name", "email", "phone", "date", "critical")
        dec, adj, fin = [], [], []
        for i, c in enumerate(self.names):
            role = self.roles[c]
            nulls = f"(n - nn_{i})"
            mv = f"(SELECT mv FROM md WHERE ci = {i})"
            mc = f"(SELECT mc FROM md WHERE ci = {i})"
            if role in qroles:
                how = f"CASE WHEN {nulls} > 0 THEN 'quarantine' END"
            else:
                how = (f"CASE WHEN {nulls} = 0 THEN NULL WHEN nn_{i} > 0 AND num_{i} / nn_{i} > 0.6 AND fin_{i} "
                       f"THEN 'median' WHEN nn_{i} = 0 THEN NULL WHEN {mc} / nn_{i} > 0.4 THEN 'mode' ELSE 'flag' END")
            med2 = f"round(med_{i}, 2)"
            fill = f"(CASE WHEN int_{i} THEN CAST(CAST(trunc({med2}) AS BIGINT) AS VARCHAR) ELSE CAST({med2} AS VARCHAR) END)"
            dec += [f"{how} AS how_{i}", f"{fill} AS fill_{i}", f"{mv} AS mv_{i}",
                    f"printf('%.0f', {mc} / nn_{i} * 100) || '%' AS pct_{i}",
                    f"{nulls} AS nulls_{i}", f"nn_{i}", f"num_{i}", f"lo_{i}", f"up_{i}", f"ti_{i}"]
            # casing after the fill, in two further stages to keep expressions shallow
            if role in ("id", "email", "date", "phone", "critical"):
                fin.append(f"NULL AS case_{i}")
                continue
            isfill = f"(how_{i} = 'mode')"
            mvc = f"mv_{i}"

            def add(flag, i=i, isfill=isfill):
                return f"(CASE WHEN {isfill} AND {flag} THEN nulls_{i} ELSE 0 END)"

            adj += [f"lo_{i} + {add(lower_style(mvc))} AS lo2_{i}",
                    f"up_{i} + {add(upper_style(mvc))} AS up2_{i}",
                    f"ti_{i} + {add(title_style(mvc))} AS ti2_{i}",
                    f"nn_{i} + CASE WHEN {isfill} THEN nulls_{i} ELSE 0 END AS nn2_{i}",
                    f"num_{i} + {add(f'regexp_matches({mvc}, {q(DECIMAL_TEXT)})')} AS num2_{i}"]
            lo, up, ti, nn2, num2 = (f"lo2_{i}", f"up2_{i}", f"ti2_{i}", f"nn2_{i}", f"num2_{i}")
            tot = f"({lo} + {up} + {ti})"
            mx = f"greatest({lo}, {up}, {ti})"
            style = "'title'" if role == "name" else f"(CASE WHEN {mx} = {ti} THEN 'title' WHEN {mx} = {lo} THEN 'lower' ELSE 'upper' END)"
            fin.append(f"(CASE WHEN how_{i} = 'median' THEN NULL WHEN {nn2} > 0 AND {num2} / {nn2} > 0.6 THEN NULL "
                       f"WHEN {nn2} < 3 THEN NULL WHEN {tot} = 0 THEN NULL WHEN {mx} / {tot} < 0.5 OR {mx} = {tot} "
                       f"THEN NULL ELSE {style} END) AS case_{i}")
        self.add("d5a", f"SELECT {', '.join(dec)} FROM b5", materialized=True)
        self.add("d5b", f"SELECT * , {', '.join(adj) if adj else '0 AS _z'} FROM d5a", materialized=True)
        self.add("d5", f"SELECT *, {', '.join(fin)} FROM d5b", materialized=True)

        def d(name):
            return f"(SELECT {name} FROM d5)"

        br = {}
        for i, c in enumerate(self.names):
            x = ident(c)
            how = d(f"how_{i}")
            role = self.roles[c]
            br[c] = [
                (f"{how} = 'quarantine' AND {x} IS NULL", None, "'critical'",
                 q(f"Missing {role.upper()} value in column '{c}' — cannot be inferred automatically."), False, True),
                (f"{how} = 'median' AND {x} IS NULL", d(f"fill_{i}"), "'warning'",
                 f"'Missing numeric filled with column median (' || {d(f'fill_{i}')} || ').'", True, False),
                (f"{how} = 'mode' AND {x} IS NULL", d(f"mv_{i}"), "'warning'",
                 f"'Missing text filled with dominant mode ''' || {d(f'mv_{i}')} || ''' (' || {d(f'pct_{i}')} || "
                 f"' frequency).'", True, False),
                (f"{how} = 'flag' AND {x} IS NULL", None, "'warning'",
                 q(f"Missing value in '{c}': no dominant mode — flagged for review."), False, False),
            ]
        self.step(11, br)
        br = {}
        labels = {"title": "Title Case", "lower": "lowercase", "upper": "UPPERCASE"}
        for i, c in enumerate(self.names):
            x = ident(c)
            how = d(f"case_{i}")
            for style, fn in (("title", smart_title(x)), ("lower", f"lower({x})"), ("upper", f"upper({x})")):
                br.setdefault(c, []).append(
                    (f"{how} = '{style}' AND {x} IS NOT NULL AND {fn} <> {x}", fn, "'fixed'",
                     q(f"Casing standardised to {labels[style]}."), True, False))
        self.step(12, br)

    # -- outputs -------------------------------------------------------------
    def _with(self) -> str:
        qs = " UNION ALL ".join(f"SELECT * FROM {x}" for x in self.quar) or \
            "SELECT CAST(NULL AS BIGINT) AS _row_id, 0 AS rule, 0 AS col, '' AS reason WHERE FALSE"
        cs = " UNION ALL ".join(f"SELECT * FROM {x}" for x in self.changes)
        return ("WITH " + ",\n".join(self.ctes) + f",\nqall AS ({qs}),\nchall AS ({cs}),\n"
                f"fin AS (SELECT * FROM s{self.k}),\n"
                f"qids AS (SELECT DISTINCT _row_id FROM qall),\n"
                f"clean AS (SELECT fin.*, row_number() OVER (ORDER BY _row_id) - 1 AS _pos FROM fin "
                f"WHERE _row_id NOT IN (SELECT _row_id FROM qids))\n")

    def changes_sql(self) -> str:
        if not self.ctes:
            self.build()
        return (self._with() +
                "SELECT CAST(clean._pos AS BIGINT) AS row, clean._row_id, "
                "CAST(chall.rule AS INTEGER) AS rule, CAST(chall.col AS INTEGER) AS col, chall.\"column\", "
                "chall.old_value, chall.new_value, chall.kind, chall.reason "
                "FROM chall JOIN clean USING (_row_id)")

    def clean_sql(self) -> str:
        if not self.ctes:
            self.build()
        cols = ", ".join(ident(c) for c in self.names)
        return self._with() + f"SELECT _row_id, {cols} FROM clean"

    def quarantine_sql(self) -> str:
        if not self.ctes:
            self.build()
        cols = ", ".join(f"coalesce({ident(c)}, {q(TO_BE_DETERMINED)}) AS {ident(c)}" for c in self.names)
        return (self._with() +
                f"SELECT fin._row_id, {cols}, r._issue_reason FROM fin JOIN (SELECT _row_id, "
                f"string_agg(reason, '; ' ORDER BY rule, col) AS _issue_reason FROM qall GROUP BY _row_id) r "
                f"USING (_row_id)")

    def counts_sql(self) -> str:
        if not self.ctes:
            self.build()
        return (self._with() +
                "SELECT CAST((SELECT count(*) FROM clean) AS BIGINT) AS clean_count, "
                "CAST((SELECT count(*) FROM qids) AS BIGINT) AS quarantine_count, "
                "CAST((SELECT count(*) FROM chall JOIN clean USING (_row_id) WHERE chall.kind = 'fixed') AS BIGINT) "
                "AS changes_applied")

"""Rewrites of accepted SQL forms that Spark doesn't parse or reads differently.

The statement becomes a bracket tree; queries inside brackets are rewritten
first, then each query block by its clauses. A shape that isn't recognised is
left to Spark's parser or raises; nothing is guessed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import UnsupportedSql
from tidewater.operators.relational import recursive_distinct
from tidewater.plans.tokens import Group, Token, split_on, text_of, tree, words

CLAUSES = (
    ("FROM",), ("WHERE",), ("GROUP", "BY"), ("HAVING",), ("QUALIFY",), ("WINDOW",), ("ORDER", "BY"), ("LIMIT",), ("OFFSET",), ("FETCH",),
)
SET_WORDS = ("UNION", "INTERSECT", "EXCEPT")
#: (words, what is said) of forms that are refused wherever they stand.
REFUSED = (
    (("LATERAL", "VIEW"), "LATERAL VIEW"), (("DISTRIBUTE", "BY"), "DISTRIBUTE BY"), (("CLUSTER", "BY"), "CLUSTER BY"), (("SORT", "BY"), "SORT BY"),
    (("PREWHERE",), "PREWHERE"), (("CONNECT", "BY"), "CONNECT BY"), (("BETWEEN", "SYMMETRIC"), "BETWEEN SYMMETRIC"), (("WITH", "TOTALS"), "WITH TOTALS"),
    (("WITH", "TIES"), "WITH TIES"), (("UNPIVOT",), "UNPIVOT"), (("TRY_CAST",), "TRY_CAST"), (("BY", "NAME"), "BY NAME"), (("ASOF",), "ASOF JOIN"),
    (("IGNORE", "NULLS"), "IGNORE NULLS"), (("UNNEST",), "UNNEST"), (("REPEATABLE",), "TABLESAMPLE seed"), (("BUCKET",), "TABLESAMPLE BUCKET"),
)
#: Words that may follow a table without an alias.
AFTER_TABLE = ("ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SEMI", "ANTI", "LATERAL", "TABLESAMPLE", "PIVOT")
OPPOSITE = {"=": "<>", "<>": "=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
#: Words that may end an item of a select list without being its alias, and those that an operand follows.
NO_ALIAS = ("END", "NULL", "TRUE", "FALSE", "UNKNOWN", "YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND")
BEFORE_OPERAND = ("ALL", "AND", "OR", "NOT", "LIKE", "ILIKE", "RLIKE", "IS", "IN", "FROM", "BETWEEN", "ESCAPE", "COLLATE")
_fresh = itertools.count(1)


def word(text: str) -> Token:
    return Token("word", text)


def bare(name: Token) -> str:
    return name.text.strip('"`').lower()


def parsed(text: str) -> list:
    return tree(text)


def is_query(items: list) -> bool:
    return words(items, "SELECT") or words(items, "WITH") or words(items, "VALUES") or (len(items) > 1 and items[0].kind == "group" and is_query(items[0].items) and items[1].upper in SET_WORDS)


class Rewriter:
    """``view_of`` turns the parts of a table's name into the view to read, or None to leave the name alone."""

    def __init__(self, spark: SparkSession, view_of: Callable[[list[str]], str | None] | None = None):
        self.spark, self.view_of = spark, view_of
        self.local: set[str] = set()
        self.scope: list = []  # the WITH entries in sight, each with a comma

    def rewrite(self, sql: str) -> str:
        items = parsed(sql)
        self.local, self.scope = set(), []
        self.refuse(items)
        return text_of(self.query(items, top=True))

    # -- refusals ------------------------------------------------------------

    def refuse(self, items: list) -> None:
        for i, x in enumerate(items):
            if x.kind == "group":
                self.refuse(x.items)
                continue
            for shape, said in REFUSED:
                if x.upper == shape[0] and words(items[i:], *shape):
                    after = items[i + len(shape)] if i + len(shape) < len(items) else None
                    if len(shape) == 1 and shape[0] in ("BUCKET", "ASOF", "UNNEST", "REPEATABLE", "PREWHERE", "UNPIVOT") and not (after is not None and (after.kind == "group" or shape[0] in ("ASOF", "PREWHERE"))):
                        continue
                    raise UnsupportedSql(f"unsupported SQL: {said}")
            if x.upper == "SELECT" and words(items[i:], "SELECT", "TOP"):
                raise UnsupportedSql("unsupported SQL: TOP")
            if x.upper in ("STRING_AGG", "LISTAGG") and i + 1 < len(items) and items[i + 1].kind == "group":
                inner = items[i + 1].items
                if any(words(inner[k:], "ORDER", "BY") or words(inner[k:], "LIMIT") for k in range(len(inner))):
                    raise UnsupportedSql("unsupported SQL: ORDER BY or LIMIT inside STRING_AGG")
                if words(items[i + 2 :], "FILTER"):
                    raise UnsupportedSql("unsupported SQL: FILTER on STRING_AGG")

    # -- queries -------------------------------------------------------------

    def query(self, items: list, top: bool = False) -> list:
        if words(items, "WITH"):
            return self.with_query(items, top)
        branches, joins = self.branches(items)
        if len(branches) == 1:
            return self.block(items, top)
        done: list = []
        tail: list = []
        last, clauses = branches[-1], {}
        if words(last, "SELECT"):
            clauses = self.clauses(last)
            tail = [x for k in ("ORDER BY", "LIMIT", "OFFSET", "FETCH") if k in clauses for x in self.tail(k, clauses[k])]
            branches[-1] = [x for k, part in clauses.items() if k not in ("ORDER BY", "LIMIT", "OFFSET", "FETCH") for x in [*self.key(k), *part]]
        for i, b in enumerate(branches):
            if i:
                done += joins[i - 1]
            done += [Group(self.query(b[0].items))] if len(b) == 1 and b[0].kind == "group" else self.block(b)
        return done + tail

    def branches(self, items: list) -> tuple[list[list], list[list]]:
        branches, joins = [[]], []
        i = 0
        while i < len(items):
            x = items[i]
            if x.kind == "word" and x.upper in SET_WORDS and branches[-1] and not (branches[-1][-1].kind != "group" and branches[-1][-1].text == "*"):
                op = [x]
                if i + 1 < len(items) and items[i + 1].upper in ("ALL", "DISTINCT"):
                    op.append(items[i + 1])
                    i += 1
                joins.append(op)
                branches.append([])
            else:
                branches[-1].append(x)
            i += 1
        return branches, joins

    def with_query(self, items: list, top: bool = False) -> list:
        i, recursive, outside = 1, False, self.scope
        head: list = [items[0]]
        if words(items[1:], "RECURSIVE"):
            recursive, i = True, 2
            head.append(items[1])
        while True:
            name = items[i]
            earlier = head[2 if recursive else 1 :]
            head.append(name)
            self.local.add(bare(name))
            i += 1
            columns = None
            if i < len(items) and items[i].kind == "group":
                columns = items[i]
                head.append(columns)
                i += 1
            if not words(items[i:], "AS") or i + 1 >= len(items) or items[i + 1].kind != "group":
                raise UnsupportedSql("unsupported SQL: WITH entry without AS (query)")
            body = items[i + 1].items
            if recursive and columns is None and self.mentions(body, name):
                raise UnsupportedSql("WITH RECURSIVE needs a column list")
            if recursive and self.mentions(body, name) and any(not (len(j) == 2 and j[1].upper == "ALL") for j in self.branches(body)[1]):
                head += [items[i], Group(parsed(f"SELECT * FROM {self.fixpoint(name, columns, body, earlier)}"))]
            else:
                head += [items[i], Group(self.query(body))]
            i += 2
            self.scope = [*outside, *head[2 if recursive else 1 :], Token("mark", ",")]
            if i < len(items) and items[i].kind != "group" and items[i].text == ",":
                head.append(items[i])
                i += 1
                continue
            done = head + self.query(items[i:], top)
            self.scope = outside
            return done

    def fixpoint(self, name: Token, columns: Group, body: list, earlier: list) -> str:
        """A view of the rows of a recursive UNION, which is run here, round by round."""
        branches, joins = self.branches(body)
        if any(j[0].upper != "UNION" or len(j) > 1 and j[1].upper == "ALL" for j in joins):
            raise UnsupportedSql("unsupported SQL: WITH RECURSIVE with UNION beside another set operation")
        names = [c[0].text.strip('"`') for c in split_on(columns.items, ",")]
        view = f"__fix{next(_fresh)}"

        def rows(branch: list, own: list) -> DataFrame:
            inner = branch[0].items if len(branch) == 1 and branch[0].kind == "group" else branch
            known = [*earlier, *own] if own else earlier[:-1]  # ``earlier`` ends in a comma
            text = [*(parsed("WITH RECURSIVE") + known if known else []), *parsed("SELECT * FROM"), Group(self.query(inner))]
            return self.spark.sql(text_of(text)).toDF(*names)

        def union(parts: list[DataFrame]) -> DataFrame:
            whole = parts[0]
            for more in parts[1:]:
                whole = whole.union(more)
            return whole

        seeds, steps = ([b for b in branches if self.mentions(b, name) is k] for k in (False, True))
        if not seeds:
            raise UnsupportedSql("WITH RECURSIVE needs a branch without recursion")
        seed = union([rows(b, []) for b in seeds])
        own = [name, word("AS"), Group(parsed(f"SELECT * FROM {view}"))]

        def step(fresh: DataFrame) -> DataFrame:
            fresh.createOrReplaceTempView(view)
            found = union([rows(b, own) for b in steps])
            return found.select(*[found[f.name].cast(f.dataType) for f in seed.schema.fields])

        recursive_distinct(seed, step, self.stored).createOrReplaceTempView(view)
        return view

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` without its lineage, in the shared folder of ``spark.checkpoint.dir``; in a local session without that setting, in the warehouse."""
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            folder = context.getConf().get("spark.checkpoint.dir")
            if not folder and not context.master.startswith("local"):
                raise UnsupportedSql("WITH RECURSIVE with UNION needs spark.checkpoint.dir on a cluster")
            context.setCheckpointDir(folder or f"{self.spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        return df.checkpoint()

    def mentions(self, items: list, name: Token) -> bool:
        return any(self.mentions(x.items, name) if x.kind == "group" else x.text.lower() == name.text.lower() for x in items)

    def clauses(self, items: list) -> dict[str, list]:
        """The clauses of a block in order; the select list under SELECT."""
        out: dict[str, list] = {"SELECT": []}
        current, i = "SELECT", 1
        while i < len(items):
            for shape in CLAUSES:
                own = items[i].kind == "word" and words(items[i:], *shape)
                if own and shape == ("FROM",) and out["SELECT"] and words(out["SELECT"][-1:], "DISTINCT"):
                    own = False
                if own and " ".join(shape) not in out:
                    current = " ".join(shape)
                    out[current] = []
                    i += len(shape)
                    break
            else:
                out[current].append(items[i])
                i += 1
        return out

    def key(self, name: str) -> list:
        return [word(w) for w in name.split()]

    def tail(self, name: str, part: list) -> list:
        if name == "ORDER BY":
            return self.key(name) + self.ordering(self.expression(part))
        if name == "FETCH":
            return self.fetch(part)
        if name == "OFFSET" and part and part[-1].upper in ("ROW", "ROWS"):
            part = part[:-1]
        if name in ("LIMIT", "OFFSET") and any(x.kind == "word" and x.upper not in ("ALL",) for x in part):
            raise UnsupportedSql(f"unsupported SQL: {name} takes a literal")
        return self.key(name) + part

    def fetch(self, part: list) -> list:
        if not (words(part, "FIRST") or words(part, "NEXT")):
            raise UnsupportedSql("unsupported SQL: FETCH")
        rest = part[1:]
        n = Token("number", "1")
        if rest and rest[0].kind == "number":
            n, rest = rest[0], rest[1:]
        if not rest or rest[0].upper not in ("ROW", "ROWS") or not words(rest[1:], "ONLY") or len(rest) != 2:
            raise UnsupportedSql("unsupported SQL: FETCH FIRST takes a row count and ONLY")
        return [word("LIMIT"), n]

    def ordering(self, part: list) -> list:
        """NULLs last ascending and first descending, unless the key says otherwise."""
        out: list = []
        for i, key in enumerate(split_on(part, ",")):
            if i:
                out.append(Token("mark", ","))
            stated = any(words(key[k:], "NULLS") for k in range(len(key)))
            descending = key[-1:] and key[-1].upper == "DESC"
            out += key if stated else [*key, word("NULLS"), word("FIRST" if descending else "LAST")]
        return out

    def block(self, items: list, top: bool = False) -> list:
        if not words(items, "SELECT"):
            return self.expression(items)
        c = self.clauses(items)
        select = c["SELECT"]
        if "FROM" not in c and any(k in c for k in ("WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT")):
            raise UnsupportedSql("unsupported SQL: a SELECT without FROM takes no other clause")
        if any(words(select[k:], "INTO") for k in range(len(select))):
            raise UnsupportedSql("unsupported SQL: SELECT INTO")
        if "LIMIT" in c and any(x.upper == "BY" for x in c["LIMIT"]):
            raise UnsupportedSql("unsupported SQL: LIMIT BY")
        c = {k: self.relations(v) if k == "FROM" else v for k, v in c.items()}
        if words(select, "DISTINCT", "ON") and len(select) > 2 and select[2].kind == "group":
            return self.distinct_on(c)
        if words(select, "DISTINCT") and "GROUP BY" in c:
            raise UnsupportedSql("unsupported SQL: DISTINCT with GROUP BY")
        c, names = (c, []) if top else self.limit_keys(c)
        inner = self.shaped(c)
        return parsed(f"SELECT * EXCEPT ({', '.join(names)}) FROM") + [Group(inner), word(f"__q{next(_fresh)}")] if names else inner

    def shaped(self, c: dict[str, list]) -> list:
        c["SELECT"] = self.exclusions(self.stars(c))
        if any(self.mentions([x], word("EXCLUDE")) for x in c.get("WINDOW", []) if x.kind == "group"):
            raise UnsupportedSql("unsupported SQL: EXCLUDE in a named window")
        frames = self.frames(c)
        if frames is not None:
            return frames
        hidden = self.hidden_keys(c)
        if hidden is not None:
            return hidden
        if "QUALIFY" in c:
            return self.qualify(c)
        return self.assemble(c)

    def assemble(self, c: dict[str, list]) -> list:
        out = [word("SELECT"), *self.expression(c["SELECT"])]
        fetched = "FETCH" in c and "OFFSET" in c
        for k, part in c.items():
            if k == "SELECT" or (fetched and k == "OFFSET"):
                continue
            if k in ("ORDER BY", "LIMIT", "OFFSET", "FETCH"):
                out += self.tail(k, part)
            else:
                out += self.key(k) + (part if k == "FROM" else self.expression(part))
        if fetched:
            out += self.tail("OFFSET", c["OFFSET"])
        return out

    def outer(self, inner: list, c: dict[str, list], extra: list | None = None, columns: str = "*") -> list:
        """``SELECT columns FROM (inner) WHERE extra`` with the block's ordering and limits."""
        out = parsed(f"SELECT {columns} FROM") + [Group(inner), word(f"__q{next(_fresh)}")]
        if extra:
            out += [word("WHERE"), *extra]
        for k in ("ORDER BY", "LIMIT", "FETCH", "OFFSET"):
            if k in c:
                out += self.tail(k, c[k])
        return out

    def qualify(self, c: dict[str, list]) -> list:
        cond = c["QUALIFY"]
        if any(words(cond[k:], "OVER") for k in range(len(cond))):
            raise UnsupportedSql("unsupported SQL: QUALIFY takes an alias of the select list, no window call")
        inner = {k: v for k, v in c.items() if k not in ("QUALIFY", "ORDER BY", "LIMIT", "OFFSET", "FETCH")}
        return self.outer(self.assemble(inner), c, self.expression(cond))

    def distinct_on(self, c: dict[str, list]) -> list:
        keys, rest = c["SELECT"][2].items, c["SELECT"][3:]
        name = f"__rn{next(_fresh)}"
        order = self.ordering(self.expression(c.get("ORDER BY", keys)))
        over = parsed("row_number() OVER") + [Group([*parsed("PARTITION BY"), *self.expression(keys), *parsed("ORDER BY"), *order]), word("AS"), word(name)]
        inner = {k: v for k, v in c.items() if k not in ("ORDER BY", "LIMIT", "OFFSET", "FETCH")}
        inner["SELECT"] = [*rest, Token("mark", ","), *over]
        return self.outer(self.assemble(inner), c, parsed(f"{name} = 1"), f"* EXCEPT ({name})")

    def limit_keys(self, c: dict[str, list]) -> tuple[dict[str, list], list[str]]:
        """A block below the top with the keys of its limit in its output, and the names of those that were not.

        Spark numbers the rows of a correlated LIMIT by the sort right below it. Where a key is not in the output,
        a projection stands between them, and the numbers follow whatever order the rows arrive in.
        """
        if "ORDER BY" not in c or not any(k in c for k in ("LIMIT", "OFFSET", "FETCH")) or words(c["SELECT"], "DISTINCT"):
            return c, []
        select, names, order = list(self.stars(c)), [], []
        listed, aliases = set(), {}
        for item in split_on(select, ","):
            if not item or item[-1].kind not in ("word", "name"):
                continue
            if all(x.kind in ("word", "name") for x in item[::2]) and all(x.kind == "mark" and x.text == "." for x in item[1::2]):
                listed.add(bare(item[-1]))
            elif item[-2].upper == "AS":
                aliases[bare(item[-1])] = item[:-2]
            elif item[-2].kind != "mark" and item[-2].upper not in BEFORE_OPERAND and item[-1].upper not in NO_ALIAS:
                aliases[bare(item[-1])] = item[:-1]
        listed |= set(aliases)
        for k in split_on(c["ORDER BY"], ","):
            at = next((i for i, x in enumerate(k) if x.kind == "word" and x.upper in ("ASC", "DESC", "NULLS")), len(k))
            own = k[:at]
            if len(own) != 1 or not (own[0].kind == "number" or own[0].kind in ("word", "name") and bare(own[0]) in listed):
                names.append(f"__key{next(_fresh)}")
                select += [Token("mark", ","), *self.unaliased(own, aliases), word("AS"), word(names[-1])]
                own = [word(names[-1])]
            order += [*([Token("mark", ",")] if order else []), *own, *k[at:]]
        return ({**c, "SELECT": select, "ORDER BY": order}, names) if names else (c, [])

    def unaliased(self, items: list, aliases: dict[str, list]) -> list:
        """An expression of ORDER BY with the select list's aliases written out."""
        out: list = []
        for i, x in enumerate(items):
            before, after = items[i - 1] if i else None, items[i + 1] if i + 1 < len(items) else None
            part = before is not None and (before.kind in ("number", "string") or before.upper in (".", "::", "AS"))
            part = part or after is not None and (after.kind in ("group", "string") or after.upper in (".", "FROM"))
            if x.kind == "group":
                out.append(x if is_query(x.items) else Group(self.unaliased(x.items, aliases)))
            elif x.kind in ("word", "name") and bare(x) in aliases and not part:
                out.append(Group(list(aliases[bare(x)])))
            else:
                out.append(x)
        return out

    def hidden_keys(self, c: dict[str, list]) -> list | None:
        """A subquery in ORDER BY becomes a column below the sort."""
        if "ORDER BY" not in c:
            return None
        keys = split_on(c["ORDER BY"], ",")
        inside = [any(x.kind == "group" and is_query(x.items) for x in k) for k in keys]
        if not any(inside) or words(c["SELECT"], "DISTINCT"):
            return None
        select, names, order = list(c["SELECT"]), [], []
        for k, own in zip(keys, inside, strict=True):
            if order:
                order.append(Token("mark", ","))
            if own:
                at = next((i for i, x in enumerate(k) if x.kind == "word" and x.upper in ("ASC", "DESC", "NULLS")), len(k))
                names.append(f"__key{next(_fresh)}")
                select += [Token("mark", ","), *k[:at], word("AS"), word(names[-1])]
                order += [word(names[-1]), *k[at:]]
            else:
                order += k
        inner = {k: v for k, v in c.items() if k not in ("ORDER BY", "LIMIT", "OFFSET", "FETCH")}
        inner["SELECT"] = select
        return self.outer(self.assemble(inner), {**c, "ORDER BY": order}, None, f"* EXCEPT ({', '.join(names)})")

    def frames(self, c: dict[str, list]) -> list | None:
        """GROUPS frames: a dense rank below, a RANGE frame over it above."""
        ranks: list = []

        def lowered(items: list) -> list:
            out = []
            for i, x in enumerate(items):
                if x.kind != "group" or is_query(x.items):
                    out.append(x)
                    continue
                at = next((k for k in range(len(x.items)) if words(x.items[k:], "GROUPS")), None) if i and items[i - 1].upper == "OVER" else None
                if at is None:
                    out.append(Group(lowered(x.items)))
                    continue
                if "GROUP BY" in c:
                    raise UnsupportedSql("unsupported SQL: GROUPS frame over an aggregation")
                spec, frame = x.items[:at], x.items[at + 1 :]
                order = next((k for k in range(len(spec)) if words(spec[k:], "ORDER", "BY")), None)
                if order is None:
                    raise UnsupportedSql("a GROUPS frame needs ORDER BY")
                name = f"__grp{next(_fresh)}"
                ranked = [*spec[:order], *parsed("ORDER BY"), *self.ordering(spec[order + 2 :])]
                ranks.extend([Token("mark", ","), *parsed("dense_rank() OVER"), Group(self.expression(ranked)), word("AS"), word(name)])
                out.append(Group([*spec[:order], *parsed(f"ORDER BY {name} ASC NULLS LAST RANGE"), *frame]))
            return out

        select = lowered(c["SELECT"])
        if not ranks:
            return None
        base = [word("SELECT"), Token("mark", "*"), *ranks, word("FROM"), *c["FROM"]]
        if "WHERE" in c:
            base += [word("WHERE"), *self.expression(c["WHERE"])]
        relation = [Group(base), self.alias_of(c["FROM"])]
        return self.assemble({"SELECT": select, "FROM": relation, **{k: v for k, v in c.items() if k not in ("SELECT", "FROM", "WHERE")}})

    def exclusions(self, items: list) -> list:
        """Frames with EXCLUDE: the aggregate of what is before, after and left of the current rows."""
        out: list = []
        for x in items:
            if x.kind != "group":
                out.append(x)
                continue
            at = next((k for k in range(len(x.items)) if words(x.items[k:], "EXCLUDE")), None) if out and out[-1].upper == "OVER" else None
            if at is None:
                out.append(x if is_query(x.items) else Group(self.exclusions(x.items)))
                continue
            what = " ".join(y.upper for y in x.items[at + 1 :])
            if what == "NO OTHERS":
                out.append(Group(x.items[:at]))
                continue
            if len(out) < 3 or out[-2].kind != "group" or out[-3].kind != "word" or words(out[-2].items, "DISTINCT"):
                raise UnsupportedSql("unsupported SQL: EXCLUDE takes a plain aggregate")
            name, argument = out[-3].upper, text_of(out[-2].items)
            del out[-3:]
            out += parsed(self.excluding(name, argument, x.items[:at], what))
        return out

    def excluding(self, name: str, argument: str, window: list, what: str) -> str:
        unit = next((k for k, y in enumerate(window) if y.upper in ("ROWS", "GROUPS", "RANGE")), None)
        if unit is None or (window[unit].upper, what) not in (("ROWS", "CURRENT ROW"), ("GROUPS", "GROUP"), ("GROUPS", "TIES")):
            raise UnsupportedSql(f"unsupported SQL: EXCLUDE {what} in this frame")
        bounds = window[unit + 1 :]
        if words(bounds, "BETWEEN"):
            middle = next(k for k, y in enumerate(bounds) if y.upper == "AND")
            low, high = (" ".join(y.upper for y in b) for b in (bounds[1:middle], bounds[middle + 1 :]))
        else:
            low, high = " ".join(y.upper for y in bounds), "CURRENT ROW"
        low, high = (b.replace("0 PRECEDING", "CURRENT ROW") if b.startswith("0 ") else b for b in (low, high.replace("FOLLOWING", "PRECEDING") if high.startswith("0 ") else high))
        if not (low == "CURRENT ROW" or low.endswith(" PRECEDING")) or not (high == "CURRENT ROW" or high.endswith(" FOLLOWING")):
            raise UnsupportedSql("unsupported SQL: EXCLUDE in a frame without the current row")
        sides = [f"BETWEEN {low} AND 1 PRECEDING"] if low != "CURRENT ROW" else []
        sides += [f"BETWEEN 1 FOLLOWING AND {high}"] if high != "CURRENT ROW" else []
        over = f"OVER ({text_of(window[:unit])} {window[unit].upper} "

        def parts(call: str, own: str) -> list[str]:
            return [f"{call}({argument}) {over}{side})" for side in sides] + ([own] if what == "TIES" else []) or ["NULL"]

        def total() -> str:
            each = parts("sum", argument)
            return f"(CASE WHEN coalesce({', '.join(each)}) IS NOT NULL THEN {' + '.join(f'coalesce({p}, 0)' for p in each)} END)"

        def count() -> str:
            own = "1" if argument == "*" else f"CASE WHEN ({argument}) IS NULL THEN 0 ELSE 1 END"
            return "CAST(" + " + ".join(f"coalesce({p}, 0)" for p in parts("count", own)) + " AS BIGINT)"

        if name in ("MIN", "MAX"):
            each = parts(name, argument)
            return each[0] if len(each) == 1 else f"{'least' if name == 'MIN' else 'greatest'}({', '.join(each)})"
        if name == "SUM":
            return total()
        if name == "COUNT":
            return count()
        if name == "AVG":
            return f"(CAST({total()} AS DOUBLE) / nullif({count()}, 0))"
        raise UnsupportedSql(f"unsupported SQL: EXCLUDE with {name}")

    def alias_of(self, relation: list) -> Token:
        last = relation[-1]
        if len(split_on(relation, ",")) > 1 or any(x.upper == "JOIN" for x in relation) or last.kind not in ("word", "name"):
            raise UnsupportedSql("unsupported SQL: this form needs a single relation in FROM")
        return last

    def stars(self, c: dict[str, list]) -> list:
        """``* EXCLUDE / REPLACE / RENAME``, also of one relation, expanded from its columns."""
        select, before = c["SELECT"], None
        while select is not before:
            before, select = select, self.star(select, c["FROM"]) if "FROM" in c else select
        return select

    def star(self, select: list, relations: list) -> list:
        at = next((i for i, x in enumerate(select[:-1]) if x.kind != "group" and x.text == "*" and select[i + 1].upper in ("EXCLUDE", "EXCEPT", "REPLACE", "RENAME")), None)
        if at is None:
            return select
        verb = select[at + 1].upper
        spec = select[at + 2]
        inner = spec.items if spec.kind == "group" else [spec]
        end = at + 3
        if verb == "RENAME" and spec.kind != "group":
            inner, end = select[at + 2 : at + 5], at + 5
        of = ""
        if at > 1 and select[at - 1].kind != "group" and select[at - 1].text == ".":
            if at > 2 and select[at - 3].kind != "group" and select[at - 3].text == ".":
                raise UnsupportedSql(f"unsupported SQL: {verb} on a star of several parts")
            of, at = select[at - 2].render() + ".", at - 2
        columns = self.spark.sql(text_of([*parsed(f"SELECT {of}* FROM"), *relations])).columns
        changed: dict[str, str] = {}
        for part in split_on(inner, ","):
            if verb in ("EXCLUDE", "EXCEPT"):
                changed[part[0].text.strip('"`').lower()] = ""
            elif verb == "RENAME":
                changed[part[0].text.strip('"`').lower()] = f"{of}`{part[0].text.strip(chr(34) + '`')}` AS {part[-1].render()}"
            else:
                changed[part[-1].text.strip('"`').lower()] = text_of(self.expression(part))
        missing = set(changed) - {x.lower() for x in columns}
        if missing:
            raise UnsupportedSql(f"no column {sorted(missing)[0]!r} for {verb}")
        listed = [changed.get(x.lower(), f"{of}`{x}`") for x in columns]
        return [*select[:at], *parsed(", ".join(x for x in listed if x)), *select[end:]]

    # -- relations and expressions -------------------------------------------

    def table(self, items: list) -> tuple[list, int]:
        """The relation that starts ``items``, if it is a table's name, and how many tokens name it."""
        n = 1
        while n + 1 < len(items) and items[n].kind == "mark" and items[n].text == "." and items[n + 1].kind in ("word", "name"):
            n += 2
        path = [x.text.strip('"`') for x in items[:n:2]]
        if self.view_of is None or n == 1 and path[0].lower() in self.local:
            return items[:n], n
        view = self.view_of(path)
        if view is None:
            return items[:n], n
        after = items[n] if n < len(items) else None
        aliased = after is not None and (after.kind == "name" or after.kind == "word" and after.upper not in AFTER_TABLE or after.upper in ("TABLESAMPLE", "PIVOT"))
        return [word(view), *([] if aliased else [word("AS"), Token("name", f"`{path[-1]}`")])], n

    def relations(self, items: list, first: bool = True) -> list:
        """The FROM clause; ``first``: it starts with a relation, not with an expression."""
        out: list = []
        i = 0
        while i < len(items):
            x = items[i]
            here = first if not i else items[i - 1].kind != "group" and items[i - 1].upper in (",", "JOIN")
            if here and x.kind in ("word", "name") and x.upper not in ("LATERAL", "VALUES", "TABLE") and not (i + 1 < len(items) and items[i + 1].kind == "group"):
                named, n = self.table(items[i:])
                out += named
                i += n
                continue
            if x.upper == "TABLESAMPLE":
                rest = items[i + 1 :]
                if rest and rest[0].upper in ("BERNOULLI", "SYSTEM"):
                    rest, i = rest[1:], i + 1
                if not rest or rest[0].kind != "group" or len([t for t in rest[0].items if t.upper != "PERCENT"]) != 1 or rest[0].items[0].kind != "number":
                    raise UnsupportedSql("unsupported SQL: TABLESAMPLE takes a percentage")
                out += [x, Group([rest[0].items[0], word("PERCENT")])]
                i += 2
                continue
            if x.kind == "group":
                out.append(Group(self.query(x.items) if is_query(x.items) else self.relations(x.items, here) if not (out and out[-1].upper in ("USING", "PIVOT")) else x.items))
            else:
                out.append(x)
            i += 1
        return self.expression(out, inside=False)

    def expression(self, items: list, inside: bool = True) -> list:
        """Functions, operators and quantifiers; ``inside``: also rewrite bracket groups."""
        out: list = []
        i = 0
        while i < len(items):
            x = items[i]
            after = items[i + 1] if i + 1 < len(items) else None
            if x.kind == "group":
                out.append(self.group(x, out) if inside else x)
            elif x.kind == "mark" and x.text in ("~", "~*", "!~", "!~*"):
                if after is None or after.kind != "string":
                    raise UnsupportedSql("unsupported SQL: a regular expression must be a literal")
                pattern = after.text.replace("\\", "\\\\")
                if x.text.endswith("*"):
                    pattern = "'(?i)" + pattern[1:]
                out += [word("NOT RLIKE" if x.text[0] == "!" else "RLIKE"), Token("string", pattern)]
                i += 1
            elif x.kind == "mark" and x.text in ("=", "<>", "!=", "<", "<=", ">", ">=") and after is not None and after.upper in ("ANY", "SOME", "ALL"):
                body = items[i + 2] if i + 2 < len(items) else None
                if body is None or body.kind != "group" or not is_query(body.items):
                    raise UnsupportedSql(f"unsupported SQL: {after.upper} takes a subquery")
                left, at = self.operand(out)
                del out[at:]
                out += self.quantified(left, x.text, after.upper, body)
                i += 2
            elif x.kind == "word" and after is not None and after.kind == "group" and x.upper in FUNCTIONS:
                made = FUNCTIONS[x.upper](self, after.items)
                out += [x, self.group(after, out)] if made is None else made
                i += 1
            else:
                out.append(x)
            i += 1
        return out

    def group(self, g: Group, before: list) -> Group:
        if is_query(g.items):
            return Group(self.query(g.items))
        done = self.expression(g.items)
        if before and before[-1].upper == "OVER" or any(words(done[k:], "ORDER", "BY") for k in range(len(done))):
            at = next((k for k in range(len(done)) if words(done[k:], "ORDER", "BY")), None)
            if at is not None:
                end = next((k for k in range(at, len(done)) if done[k].upper in ("ROWS", "RANGE") or words(done[k:], "LIMIT")), len(done))
                done = [*done[: at + 2], *self.ordering(done[at + 2 : end]), *done[end:]]
        return Group(done)

    def operand(self, out: list) -> tuple[list, int]:
        """The operand that ends ``out``: a name path, literal, call or bracket."""
        at = len(out) - 1
        if at < 0:
            raise UnsupportedSql("a quantified comparison needs a left side")
        if out[at].kind == "group" and at and out[at - 1].kind == "word" and out[at - 1].upper not in ("AND", "OR", "NOT", "WHERE", "WHEN"):
            at -= 1
        while at >= 2 and out[at - 1].kind != "group" and out[at - 1].text == ".":
            at -= 2
        if at and out[at - 1].kind == "mark" and out[at - 1].text in ("+", "-", "*", "/", "%", "||"):
            raise UnsupportedSql("unsupported SQL: bracket the left side of a quantified comparison")
        return out[at:], at

    def quantified(self, left: list, op: str, quantifier: str, body: Group) -> list:
        """The three-valued result, from whether any comparison is true (false) or unknown.

        A subquery that stands alone is read once, for its ends and counts; only equality then joins its rows.
        """
        name = f"__v{next(_fresh)}"
        rows = f"({text_of(self.query(body.items))}) AS __s{name}({name})"
        side = text_of(left)
        compare = f"({side}) {op} {name}"
        found = lambda cond: f"EXISTS (SELECT 1 FROM {rows} WHERE {cond})"
        decided, otherwise = ("false", "true") if quantifier == "ALL" else ("true", "false")
        case = lambda hit, unknown: f"(CASE WHEN {hit} THEN {decided} WHEN {unknown} THEN CAST(NULL AS BOOLEAN) ELSE {otherwise} END)"
        joined = case(found(f"NOT ({compare})" if quantifier == "ALL" else compare), found(f"({compare}) IS NULL"))
        facts = f"(SELECT struct(min({name}) AS low, max({name}) AS high, count(*) AS n, count({name}) AS known) FROM {rows})"
        kind = self.kind_alone(facts)
        if kind is None:
            return parsed(joined)
        deciding = OPPOSITE[op] if quantifier == "ALL" else op
        ends = {"<": ("high",), "<=": ("high",), ">": ("low",), ">=": ("low",), "=": ()}.get(deciding, ("low", "high"))
        hit = " OR ".join(f"({side}) {deciding} {facts}.{end}" for end in ends)
        hit = f"{facts}.known > 0 AND ({hit})" if ends else found(f"({side}) = {name}")  # without values nothing is compared, nor cast
        bounded = case(hit, f"{facts}.known < {facts}.n OR ({side}) IS NULL AND {facts}.n > 0")
        if "string" in kind or "<" in kind:  # a comparison with another type may have another order than the values
            return parsed(f"(CASE WHEN typeof({side}) = '{kind}' THEN {bounded} ELSE {joined} END)")
        return parsed(bounded)

    def kind_alone(self, facts: str) -> str | None:
        """The type of the least value, if the subquery takes nothing from outside and its values have an order."""
        known = [*parsed("WITH RECURSIVE"), *self.scope[:-1]] if self.scope else []
        try:
            kind = self.spark.sql(text_of([*known, *parsed(f"SELECT {facts}.low AS low")])).schema["low"].dataType.simpleString()
        except AnalysisException:
            return None
        return None if "'" in kind else kind


def _arguments(r: Rewriter, items: list) -> list[str]:
    return [text_of(r.expression(a)) for a in split_on(items, ",")]


def _concat(r: Rewriter, items: list) -> list | None:
    return parsed("concat_ws('', " + ", ".join(f"CAST({a} AS STRING)" for a in _arguments(r, items)) + ")")


def _substring(r: Rewriter, items: list) -> list | None:
    """1-based; positions before the text count against the length."""
    if any(x.upper in ("FROM", "FOR") for x in items if x.kind == "word"):
        parts: list[list] = [[]]
        for x in items:
            if x.kind == "word" and x.upper in ("FROM", "FOR"):
                parts.append([])
            else:
                parts[-1].append(x)
        a = [text_of(r.expression(p)) for p in parts]
    else:
        a = _arguments(r, items)
    if len(a) == 2:
        return parsed(f"substring({a[0]}, greatest({a[1]}, 1))")
    if len(a) != 3:
        raise UnsupportedSql("SUBSTRING takes two or three arguments")
    return parsed(f"substring({a[0]}, greatest({a[1]}, 1), greatest(({a[2]}) + least(({a[1]}) - 1, 0), 0))")


def _extract(r: Rewriter, items: list) -> list | None:
    at = next((k for k, x in enumerate(items) if x.upper == "FROM"), None)
    if at is None:
        return None
    field, source = items[0].text.strip("'").upper(), text_of(r.expression(items[at + 1 :]))
    if field == "EPOCH":
        return parsed(f"(unix_micros(CAST({source} AS TIMESTAMP)) / CAST(1000000 AS DOUBLE))")
    if field == "DOW":
        return parsed(f"CAST(dayofweek({source}) - 1 AS BIGINT)")
    if field == "ISODOW":
        return parsed(f"CAST(weekday({source}) + 1 AS BIGINT)")
    return parsed(f"CAST(extract({field} FROM {source}) AS BIGINT)")


def _age(r: Rewriter, items: list) -> list | None:
    a = _arguments(r, items)
    if len(a) != 2:
        raise UnsupportedSql("AGE takes two arguments")
    return parsed(f"(CAST({a[0]} AS TIMESTAMP_NTZ) - CAST({a[1]} AS TIMESTAMP_NTZ))")


def _avg(r: Rewriter, items: list) -> list | None:
    distinct = words(items, "DISTINCT")
    inner = text_of(r.expression(items[1:] if distinct else items))
    return parsed(f"avg({'DISTINCT ' if distinct else ''}CAST({inner} AS DOUBLE))")


FUNCTIONS = {"CONCAT": _concat, "SUBSTRING": _substring, "SUBSTR": _substring, "EXTRACT": _extract, "AGE": _age, "AVG": _avg}

import datetime as dt
import re
from decimal import Decimal


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def dec(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.000001"))


def checks(violations):
    return sorted((r["check"], r["key"]) for r in violations.collect())


def names(violations):
    return sorted({r["check"] for r in violations.collect()})


def shuffles_above(df, leaf):
    """How often the rows of a scan are shuffled on their way up: exchanges among the ancestors of each plan line
    that the pattern ``leaf`` finds."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [min((line.find(c) for c in ("+-", ":-") if c in line), default=0) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if re.search(leaf, line):
            above, at = 0, depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    above, at = above + (" Exchange " in lines[j]), depth[j]
            found.append(above)
    return found

"""Profiles of JSON documents: their key paths, types and values by frame."""

from __future__ import annotations

import json
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Likenesses of names are counted in whole parts of this, so that sums of them are exact.
UNIT = 10**9
#: Pairs of names that are compared at once, and the characters of one side that are held for it.
PAIRS, CELLS = 1 << 13, 1 << 20
TYPES = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}


def parse(raw: str | None) -> dict | None:
    """The document, or None for a torn one or one that is no object."""
    try:
        doc = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def canonical(value: object) -> str:
    """Equal for equal values: key order, number notation and null members play no part."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(v)}" for k, v in sorted(value.items()) if v is not None) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) <= 2**53:
        return repr(float(value))
    return json.dumps(value)


def walk(value: dict, path: str = "", holder: str = "") -> Iterator[tuple[str, str, str, object]]:
    """(path, type, holder, value) of every field that is not null. The holder is the `file` of the
    innermost array element that has one, else the element's place; '' for the report itself."""
    for key, v in value.items():
        if v is None:
            continue
        at = f"{path}.{key}" if path else key
        yield at, TYPES[type(v)], holder, v
        if isinstance(v, dict):
            yield from walk(v, at, holder)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    yield from walk(x, f"{at}[]", x["file"] if isinstance(x.get("file"), str) else f"{holder}\0{at}\0{i}")


def h64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def profile(doc: dict) -> list[dict]:
    """One record per path: its type (the most frequent, then the first by name), and its value
    sketch: a 64-bit hash of the value for a hash of every holder, sorted by holder."""
    kinds, values, again = defaultdict(Counter), defaultdict(dict), Counter()
    for path, kind, holder, value in walk(doc):
        kinds[path][kind] += 1
        at = h64(holder)
        if at in values[path]:  # the same file once more: compared with the other report's repeat
            again[path, holder] += 1
            at = h64(f"{holder}\0{again[path, holder]}")
        values[path][at] = h64(canonical(value))
    out = []
    for path in sorted(kinds):
        kind = min(kinds[path].items(), key=lambda x: (-x[1], x[0]))[0]
        held = sorted(values[path].items())
        out.append({"path": path, "type": kind, "holders": [h for h, _ in held], "hashes": [v for _, v in held]})
    return out


def parent(path: str) -> str:
    """The path whose object (or array of objects) holds this one; '' at the top."""
    return path.rpartition(".")[0].removesuffix("[]")


def structural(before: dict[str, str], after: dict[str, str]) -> tuple[list[tuple[str, str, str]], list[str], list[str]]:
    """Retyped fields as (change, before, after), and the paths gone and new, all below unchanged parents."""
    same = {p for p in before if after.get(p) == before[p]}
    top: dict[str, bool] = {"": True}

    def stands(path: str) -> bool:
        if path not in top:
            top[path] = path in same and stands(parent(path))
        return top[path]

    retyped = [("retyped", p, p) for p in sorted(before) if p in after and p not in same and stands(parent(p))]
    gone = [p for p in sorted(before) if p not in after and stands(parent(p))]
    new = [p for p in sorted(after) if p not in before and stands(parent(p))]
    return retyped, gone, new


def agree(a: dict[int, int], b: dict[int, int]) -> bool:
    """Equal values wherever both hold one, in at least one place."""
    if len(b) < len(a):
        a, b = b, a
    common = 0
    for k, v in a.items():
        w = b.get(k)
        if w is not None:
            if w != v:
                return False
            common += 1
    return common > 0


def encoded(paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of the last parts of the paths, without case, one after the other; where each begins, its length."""
    names = [p.rpartition(".")[2].lower() for p in paths]
    sizes = np.array([len(x) for x in names], dtype=np.int64)
    return np.array([ord(c) for x in names for c in x] + [0], dtype=np.int32), np.cumsum(sizes) - sizes, sizes


def matched(a: np.ndarray, b: np.ndarray, at: np.ndarray, rows: np.ndarray, to: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many characters match, after Ratcliff and Obershelp, in each pair of texts a[at : at + rows] and
    b[to : to + cols]: the longest common block, first in a, then in b, and the same on both its sides."""
    if len(at) > 1 and len(at) * int(cols.max()) > CELLS:
        out, order = np.empty(len(at)), np.argsort(cols, kind="stable")
        for half in np.array_split(order, 2):
            out[half] = matched(a, b, at[half], rows[half], to[half], cols[half])
        return out
    out, of = np.zeros(len(at)), np.arange(len(at))
    while len(of):
        places = np.arange(cols.max())[:, None]
        text = b[np.minimum(to + places, len(b) - 1)]
        text[places >= cols] = -1
        run = np.zeros((len(places) + 1, len(of)), dtype=np.int32)
        size, x, y = (np.zeros(len(of), dtype=np.int64) for _ in range(3))
        for i in range(rows.max()):
            run[1:] = np.where(text == np.where(i < rows, a[np.minimum(at + i, len(a) - 1)], -2), run[:-1] + 1, 0)
            top = run.max(axis=0)
            better = np.flatnonzero(top > size)
            size[better] = top[better]
            x[better], y[better] = i + 1 - size[better], run[:, better].argmax(axis=0) - size[better]
        out += np.bincount(of, size, len(out))
        x_end, y_end = x + size, y + size
        sides = ((of, at, x, to, y), (of, at + x_end, rows - x_end, to + y_end, cols - y_end))
        of, at, rows, to, cols = (np.concatenate(z) for z in zip(*sides, strict=True))
        rest = np.tile(size > 0, 2) & (rows > 0) & (cols > 0)
        of, at, rows, to, cols = of[rest], at[rest], rows[rest], to[rest], cols[rest]
    return out


def likeness(old: list[str], fresh: list[str], near: list[np.ndarray]) -> list[np.ndarray]:
    """For each old path its likeness by name to the fresh ones near it, in UNITs: difflib's ratio(),
    for many pairs at once."""
    (a, at, rows), (b, to, cols) = encoded(old), encoded(fresh)
    out, some, pairs = [], [], 0
    for i, js in enumerate(near):
        some.append(i)
        pairs += len(js)
        if pairs >= PAIRS or i == len(near) - 1:
            sizes = [len(near[k]) for k in some]
            p, q = np.repeat(some, sizes), np.concatenate([near[k] for k in some])
            whole = rows[p] + cols[q]
            ratio = np.where(whole == 0, 1.0, 2.0 * matched(a, b, at[p], rows[p], to[q], cols[q]) / np.maximum(whole, 1))
            out += np.split(np.rint(ratio * UNIT).astype(np.int32), np.cumsum(sizes)[:-1])
            some, pairs = [], 0
    return out


def heaviest(near: list[np.ndarray], weights: list[np.ndarray], cols: int, bonus: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A maximum-weight bipartite matching: the column of every row (-1: none), and the optimal prices of rows
    and columns. Row i may take the columns near[i], each for its weight and the bonus (> 0 in sum).
    Successive shortest augmenting paths with prices (the Hungarian method), a row of edges a step."""
    price, cost = np.zeros(len(near)), np.zeros(cols)
    owner, mate, free = np.full(cols, -1), [-1] * len(near), np.arange(cols)
    way = np.zeros(cols, dtype=np.int64)
    for root in range(len(near)):
        price[root] = max(0.0, (weights[root] - cost[near[root]]).max(initial=-np.inf) + bonus)
        far, done = np.full(cols, np.inf), np.zeros(cols, dtype=bool)
        i, at, last, least = root, 0.0, root, price[root]  # a path may also end with a row that goes without
        rows, taken = [(root, 0.0)], []
        while True:
            js = near[i]
            slack = cost[js] - weights[i] + (at + price[i] - bonus)
            nearer = (slack < far[js]) & ~done[js]
            hit = js[nearer]
            far[hit], way[hit] = slack[nearer], i
            j = int(far.argmin())
            if len(free) and far[k := free[far[free].argmin()]] <= far[j]:
                j = int(k)
            step = far[j]
            if least <= step or owner[j] < 0:
                break
            far[j], done[j] = np.inf, True
            taken.append((j, step))
            i, at = int(owner[j]), step
            rows.append((i, at))
            if at + price[i] < least:
                last, least = i, at + price[i]
        end, step = (mate[last], least) if least <= step else (j, step)
        for i, at in rows:
            price[i] -= step - at
        for j, at in taken:
            cost[j] += step - at
        if end >= 0 and owner[end] < 0:
            free = free[free != end]
        else:
            mate[last] = -1
        while end >= 0:
            i = int(way[end])
            owner[end], mate[i], end = i, end, mate[i]
    return mate, price, cost


def first_by_order(near: list[np.ndarray], weights: list[np.ndarray], bonus: float, mate: list[int], price: np.ndarray, cost: np.ndarray) -> list[int]:
    """Of all matchings as heavy as this one, that in which the first row has its first possible column,
    then the second row, and so on. These matchings use only edges that the prices pay exactly, and
    leave out only rows and columns without a price, so they differ by alternating cycles of such edges.
    What is left out counts as matched to one spare place, which rows without a price may take as a
    column, and which may take columns without a price as a row."""
    cols, mate = len(cost), list(mate)
    tight: dict[int, np.ndarray] = {}
    fixed, owner = np.zeros(cols + 1, dtype=bool), np.full(cols + 1, -1)
    for i, j in enumerate(mate):
        if j >= 0:
            owner[j] = i

    def edges(i: int) -> np.ndarray:
        if i not in tight:
            tight[i] = near[i][cost[near[i]] + price[i] - bonus == weights[i]]
        return tight[i]

    for i in range(len(near)):
        back, spare, met, came = mate[i], -1, fixed.copy(), {}
        for first in edges(i).tolist():
            if first == back:
                break
            if met[first]:
                continue
            met[first], came[first] = True, i
            todo, end = deque([first]), -1
            while todo and end < 0:
                j = todo.popleft()
                k = int(owner[j])
                if k >= 0:
                    takers = [k]
                    if price[k] == 0 and not met[cols]:
                        met[cols], came[cols] = True, k
                        todo.append(cols)
                elif spare >= 0:
                    continue
                elif back < 0:
                    spare = end = j
                    break
                else:  # the spare place lost this column, or took in a row: it leaves out another column, or gives up a row
                    spare, takers = j, [r for r in range(i + 1, len(near)) if mate[r] < 0]
                    if cost[back] == 0:
                        came[back], end = -1, back
                        break
                    fresh = np.flatnonzero((cost == 0) & ~met[:cols] & (owner[:cols] >= 0))
                    met[fresh] = True
                    came.update(dict.fromkeys(fresh.tolist(), -1))
                    todo.extend(fresh.tolist())
                for k in takers:
                    if (edges(k) == back).any():
                        came[back], end = k, back
                        break
                    fresh = edges(k)[~met[edges(k)]]
                    met[fresh] = True
                    came.update(dict.fromkeys(fresh.tolist(), k))
                    todo.extend(fresh.tolist())
            if end >= 0:
                k = -1
                while k != i:
                    k = came[end]
                    if k < 0:
                        owner[end], end = -1, spare
                        continue
                    before, mate[k] = mate[k], end if end < cols else -1
                    if end < cols:
                        owner[end] = k
                    end = before if before >= 0 else spare
                break
        if mate[i] >= 0:
            fixed[mate[i]] = True
    return mate


def assign(weights: dict[tuple[int, int], float], rows: int, cols: int) -> list[tuple[int, int]]:
    """A maximum-weight bipartite matching of the given edges (weights > 0), as sorted pairs."""
    near = [np.array([j for j in range(cols) if (i, j) in weights], dtype=np.int64) for i in range(rows)]
    mate, *_ = heaviest(near, [np.array([weights[i, int(j)] for j in js]) for i, js in enumerate(near)], cols)
    return [(i, j) for i, j in enumerate(mate) if j >= 0]


def renames(gone: list[tuple[str, str, dict[int, int]]], new: list[tuple[str, str, dict[int, int]]]) -> list[tuple[str, str]]:
    """Pairs (old path, new path) that are one field under two names: same parent, same type, values
    that agree. A field with several possible partners gets the one that leaves most fields
    matched, then the most similar names in sum, then the first by order of the given fields."""
    # fields with the same values have the same partners, so each set of values is compared once
    left, right = same_values(gone), same_values(new)
    # fields that agree share a value in some place, so only those with a common (place, value) are compared
    at: dict[tuple, list[int]] = defaultdict(list)
    for b, (j, *_) in enumerate(right):
        q, kind, held = new[j]
        for item in held.items():
            at[parent(q), kind, item].append(b)
    near: dict[int, list[int]] = {}
    for a, (i, *_) in enumerate(left):
        p, kind, held = gone[i]
        met = {b for item in held.items() for b in at.get((parent(p), kind, item), ())}
        near[a] = [b for b in sorted(met) if agree(held, new[right[b][0]][2])]
    out: list[tuple[int, int]] = []
    for olds, fresh in components(near):
        partners: dict[int, list[int]] = {}
        for a in olds:
            partners.update(dict.fromkeys(left[a], sorted(j for b in near[a] for j in right[b])))
        rows, cols = sorted(partners), [j for b in fresh for j in right[b]]
        out += most_pairs(rows, partners, {i: gone[i][0] for i in rows}, {j: new[j][0] for j in cols})
    return [(gone[i][0], new[j][0]) for i, j in sorted(out)]


def same_values(side: list[tuple[str, str, dict[int, int]]]) -> list[list[int]]:
    """The numbers of the fields, those with the same parent, type and values by place together."""
    found: dict[tuple, list[list[int]]] = defaultdict(list)
    for i, (path, kind, held) in enumerate(side):
        sets = found[parent(path), kind, hash(frozenset(held.items()))]
        for fields in sets:
            if side[fields[0]][2] == held:
                fields.append(i)
                break
        else:
            sets.append([i])
    return [fields for sets in found.values() for fields in sets]


def components(near: dict[int, list[int]]) -> list[tuple[list[int], list[int]]]:
    """The connected parts of a bipartite graph, as sorted (left, right); lefts without an edge are in none."""
    back: dict[int, list[int]] = defaultdict(list)
    for i, js in near.items():
        for j in js:
            back[j].append(i)
    seen: set[int] = set()
    out = []
    for start in near:
        if start in seen or not near[start]:
            continue
        left, right, todo = {start}, set(), [start]
        while todo:
            for j in near[todo.pop()]:
                if j not in right:
                    right.add(j)
                    fresh = [i for i in back[j] if i not in left]
                    left.update(fresh)
                    todo += fresh
        seen |= left
        out.append((sorted(left), sorted(right)))
    return out


def most_pairs(rows: list[int], near: dict[int, list[int]], old: dict[int, str], fresh: dict[int, str]) -> list[tuple[int, int]]:
    """As many pairs as possible, then the most similar names in sum (to nine digits), then the first
    partner for the first row, and so on. Any number of fields is matched in this one way."""
    cols = sorted(fresh)
    if len(rows) == len(cols) == 1:
        return [(rows[0], cols[0])] if near[rows[0]] else []
    place = {j: k for k, j in enumerate(cols)}
    lists = {id(near[i]): np.array(sorted(place[j] for j in near[i]), dtype=np.int32) for i in rows}
    edges = [lists[id(near[i])] for i in rows]
    likes = likeness([old[i] for i in rows], [fresh[j] for j in cols], edges)
    bonus = float(UNIT) * (min(len(rows), len(cols)) + 1)  # a pair outweighs all likeness
    if len(rows) <= len(cols):
        mate, price, cost = heaviest(edges, likes, len(cols), bonus)
    else:  # from the smaller side, as every row left over takes a search of all columns
        ends = np.concatenate(edges)
        order, cuts = np.argsort(ends, kind="stable"), np.cumsum(np.bincount(ends, minlength=len(cols)))[:-1]
        takers = np.repeat(np.arange(len(rows), dtype=np.int32), [len(js) for js in edges])[order]
        back, cost, price = heaviest(np.split(takers, cuts), np.split(np.concatenate(likes)[order], cuts), len(rows), bonus)
        mate = [-1] * len(rows)
        for j, k in enumerate(back):
            if k >= 0:
                mate[k] = j
    mate = first_by_order(edges, likes, bonus, mate, price, cost)
    return [(rows[k], cols[j]) for k, j in enumerate(mate) if j >= 0]


def one_name(pairs: list[tuple[str, str, int]], held: list[list[str]], use: dict[str, int]) -> Callable[[str], str]:
    """The function that gives a path its one name, from renames (path, path, reports), the sets of
    renamed paths that frames hold, and the reports that use a path. Classes of names are joined
    from the top down, so that a renamed object counts once for all that is below it, and by the
    number of reports, but never if one frame holds names of both."""
    chosen: dict[str, str] = {}

    def named(path: str) -> str:
        out = ""
        for part in path.split("."):
            at = f"{out}.{part}" if out else part
            bare = at.removesuffix("[]")
            out = chosen.get(bare, bare) + at[len(bare) :]
        return out

    for depth in sorted({p.count(".") for p, *_ in pairs}):
        seen, places, uses = Counter(), Counter(), Counter()
        for p, q, n in pairs:
            if p.count(".") == depth and named(p) != named(q):
                seen[tuple(sorted((named(p), named(q))))] += n
        ends = {named(p) for pair in pairs for p in pair[:2] if p.count(".") == depth}
        for i, names in enumerate(held):
            for name in {named(p) for p in names} & ends:
                places[name] |= 1 << i
        for p, n in use.items():
            uses[named(p)] += n
        members = {name: [name] for name in ends}
        owner = {name: name for name in ends}
        for (p, q), _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            p, q = owner[p], owner[q]
            if p != q and not places[p] & places[q]:
                places[p] |= places[q]
                members[p] += members.pop(q)
                owner.update(dict.fromkeys(members[p], p))
        for names in members.values():
            best = min(names, key=lambda x: (-uses[x], x))
            chosen.update({name: best for name in names if name != best})
    return named

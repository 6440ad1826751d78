"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def link_components(rows, width, num, den):
    """{id: (set size, smallest id reachable)} of (id, text) rows."""
    rows = sorted(rows)
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in lists.get(g, ())).items():
            if den * common >= num * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            lists.setdefault(g, []).append(i)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def covered(n, starts, length):
    out = [False] * n
    for s in starts:
        out[s : s + length] = [True] * length
    return out


def repeated_bytes(rows, length):
    """{id: (bytes, covered flags)}: strings of ``length`` bytes that start at two places."""
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    return {i: (d, covered(len(d), [k for k in range(len(d) - length + 1) if seen[d[k : k + length]] > 1], length)) for i, d in data.items()}


def later_words(rows, length):
    """{id: (words, covered flags)}: windows of ``length`` words that start earlier too."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        words, again = WORD.findall(t or ""), []
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if w in seen:
                again.append(k)
            seen.add(w)
        out[i] = (words, covered(len(words), again, length))
    return out


def spans(flags):
    return sum(1 for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1]))


def targets(sizes, weights, limit):
    """{source: target} by repeated sharing of the excess; sizes: {source: size}, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = sum(weight[s] for s in free)
        new = {s: limit * sizes[s] for s in free if share and rest * weight[s] / share >= limit * sizes[s]}
        if not new:
            return fixed | {s: rest * weight[s] / share for s in free}
        fixed |= new


def aligned(text, tokenizer_a, pieces_b):
    """(A ids, B ids, groups, linked pairs with repeats) of a whole text, or None without tokens.
    ``tokenizer_a`` and ``pieces_b`` give (ids, bytes of each id)."""
    if not text:
        return None
    want = b" " + text.encode()
    ids_a, bytes_a = tokenizer_a(" " + text)
    ids_b, bytes_b = pieces_b(text)
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None

    def ranges(parts):
        end, out = 0, []
        for p in parts:
            out.append((end, end + len(p)))
            end += len(p)
        return out

    at_a, at_b = ranges(bytes_a), ranges(bytes_b)
    both = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups, lo = [], 0
    for hi in both:
        groups.append(
            ",".join(str(i) for i, (s, e) in zip(ids_a, at_a) if lo <= s and e <= hi)
            + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, at_b) if lo <= s and e <= hi)
        )
        lo = hi
    links = [(a, b) for a, (s, e) in zip(ids_a, at_a) for b, (u, v) in zip(ids_b, at_b) if s < v and u < e]
    return ids_a, ids_b, groups, links


def slipped_words(rows, crc32):
    """Word counts of (doc_id, text) rows."""
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower_ascii(run)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    """{word: (form, root, n, n_near, form_n)}."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}

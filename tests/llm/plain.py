"""Plain versions of the operators, for small tables: everything in lists and by definition."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, size=5):
    words = WORD.findall(lower_ascii(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(rows, percent=85):
    """key -> smallest key that can be reached, comparing every pair."""
    keys = sorted({k for k, _ in rows})
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [(k, shingles(t)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                a_root, b_root = root(a), root(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {k: root(k) for k in keys}


def base_counts(text):
    """The base counts of the quality rules."""
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + j
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for j in range(3)
    }
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def templates(line, leading=2, fields=4, min_tokens=5, min_variable=10):
    """The templates of a line: itself, and with one variable field."""
    bare = line.strip(" \t\r\f\v")
    tokens = re.split(r"[ \t\r\f\v]+", re.sub("[0-9]+", "0", bare))
    n = len(tokens)
    if n < min_tokens:
        return [("short", bare)] if bare else []
    head, rest = tuple(tokens[:leading]), []
    bounds = [leading + (n - leading) * i // fields for i in range(fields)] + [n]
    rest = [tuple(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]
    found = [(n, head, tuple(rest))]
    if n >= min_variable:
        found += [
            (n, head, tuple("*" if i == j else r for j, r in enumerate(rest))) for i in range(fields)
        ]
    return found


def drop_recurring(rows):
    """The texts without lines whose template is first in a document of a smaller key."""
    first = {}
    lines = collections.defaultdict(set)  # a line without variable fields -> all its templates
    for key, text in rows:
        for line in (text or "").split("\n"):
            for t in (all_of := templates(line)):
                first[t] = min(first.get(t, key), key)
                lines[all_of[0]].update(all_of)
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None))
            continue
        left = [
            x
            for x in text.split("\n")
            if not any(first[t] < key for t in templates(x))
        ]
        out.append((key, "\n".join(left)))
    return out

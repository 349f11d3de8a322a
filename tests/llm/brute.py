"""Plain reference versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import heapq
import itertools
import math
import re
import string
import zlib

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def white_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def substring_dedup(docs: dict, length: int = 50) -> dict:
    seen, out = set(), {}
    for key in sorted(docs):
        words = white_words(docs[key])
        covered, new = [False] * len(words), set()
        for at in range(len(words) - length + 1):
            window = tuple(words[at : at + length])
            if window in seen:
                covered[at : at + length] = [True] * length
            new.add(window)
        seen |= new
        kept = " ".join(word for word, gone in zip(words, covered, strict=True) if not gone)
        out[key] = len(words), sum(covered), sha(kept)
    return out


def suffix_dedup(docs: dict, least: int = 100) -> dict:
    seen, out = set(), {}
    for key in sorted(docs):
        data = (docs[key] or "").encode()
        covered = bytearray(len(data))
        for at in range(len(data) - least + 1):
            window = data[at : at + least]
            if window in seen:
                covered[at : at + least] = b"\1" * least
            seen.add(window)
        kept = bytes(itertools.compress(data, (1 - one for one in covered)))
        spans = sum(1 for gone, _ in itertools.groupby(covered) if gone)
        out[key] = len(data), sum(covered), spans, sha(kept)
    return out


def near_groups(docs: dict, percent: int = 80, width: int = 2) -> dict:
    sets = {}
    for key, text in docs.items():
        words = white_words(lower(text))
        grams = zip(*(words[at:] for at in range(width)), strict=False)
        sets[key] = set(grams) if len(words) >= width else {tuple(words)} if words else set()
    root = {key: key for key in docs}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for one, other in itertools.combinations(sorted(docs), 2):
        shared, union = len(sets[one] & sets[other]), len(sets[one] | sets[other])
        if union and 100 * shared >= percent * union:
            low, high = sorted((find(one), find(other)))
            root[high] = low
    return {key: (len(sets[key]), find(key), find(key) == key) for key in docs}


def decontaminate(docs: dict, items: dict, window: int = 10) -> dict:
    out = {}
    parts = {key: plain_words(text) for key, text in items.items()}
    for key, text in docs.items():
        words, hit, found = plain_words(text), set(), set()
        for item, own in parts.items():
            size = min(window, len(own))
            if not size:
                continue
            windows = {tuple(own[at : at + size]) for at in range(len(own) - size + 1)}
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
        out[key] = len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)
    return out


def license_base(text: str | None, base: dict) -> tuple:
    words, places, labels = plain_words(text), [], set()
    for phrase, label in base.items():
        own = phrase.split()
        found = [at for at in range(len(words) - len(own) + 1) if words[at : at + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def damaged(rows: list[tuple]) -> list[tuple]:
    """(conv, turn, role, text) with the faults of the contract planted."""
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def repaired(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash: the cheapest way by a heap of (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [row[1] for row in rows if row[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    follows, names = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return gaps, *(faults.count(one) for one in "bdt"), illegal, cost, audit, sha("\n".join(out))
        if (at, state) in done:
            continue
        done.add((at, state))
        given = [one for one in follows[state] if one in names]
        for one in given:
            heapq.heappush(heap, (cost + 3, audit + "I", at, one, (*out, names[one] + ":")))
        if at < len(rows):
            _, _, role, text = rows[at]
            more = 3 * (faults[at] == "t")
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if faults[at] not in ("b", "d"):
                if role and role[0] in follows[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*out, f"{role}:{text}")))
                for one in given:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, one, (*out, f"{names[one]}:{text}")))
    raise AssertionError


def repair(rows: list[tuple]) -> dict:
    parts = {row[0]: [] for row in rows}
    for row in damaged(rows):
        parts[row[0]].append(row)
    return {conv: repaired(part) if part else (0, 0, 0, 0, 0, 0, "", sha("")) for conv, part in parts.items()}


def water_level(sizes: list[int], weights: list[float], cap: int = 3) -> list[float]:
    """Targets: shares by weight, cut at the cap, what is cut shared again until none is above."""
    full: set[int] = set()
    while True:
        free = [at for at in range(len(sizes)) if at not in full]
        left = sum(sizes) - sum(cap * sizes[at] for at in full)
        share = left / sum(weights[at] for at in free) if free else 0
        targets = [cap * size if at in full else weights[at] * share for at, size in enumerate(sizes)]
        above = {at for at in free if targets[at] > cap * sizes[at]}
        if not above:
            return targets
        full |= above


def _tree(nodes: list[str], fanout: int) -> tuple[str, list[list]]:
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, node in enumerate(at):
            begin = node - node % fanout
            paths[leaf].append((node - begin, nodes[begin : begin + fanout]))
            at[leaf] //= fanout
        nodes = [sha("".join(nodes[begin : begin + fanout])) for begin in range(0, len(nodes), fanout)]
    return nodes[0], paths


def manifest(rows: list[tuple], fanout: int = 8) -> list[tuple]:
    """Per (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded root, verified."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups: dict = {}
    for row in rows:
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        low = (*row[:4], lower(row[4]) if row[4] is not None else None)
        groups.setdefault(row[2], []).append((row[0], leaf(row), leaf(low) if hit else leaf(row)))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    for part in groups.values():
        part.sort(key=lambda one: (one[0] is not None, one[0] or 0, one[1]))
    trees = {name: _tree([one[1] for one in groups[name]], fanout) for name in names}
    root, above = _tree([trees[name][0] for name in names], fanout)
    out = []
    for name, rest in zip(names, above, strict=True):
        for (key, own, shown), path in zip(groups[name], trees[name][1], strict=True):
            others, folded = "", shown
            for place, run in path + rest:
                others += "".join(run[:place] + run[place + 1 :])
                folded = sha("".join([*run[:place], folded, *run[place + 1 :]]))
            out.append((key, own, trees[name][0], root, sha(others), folded, folded == root))
    return out


def languages(texts: dict, labels: dict) -> dict:
    """doc: (language, posterior): known words by log frequency, others by their longest known n-grams."""
    pattern = re.compile(r"[^\W\d_]+")
    split = {key: pattern.findall((text or "").lower()) for key, text in texts.items()}
    names = sorted({label for label in labels.values() if label is not None})
    words = {name: collections.Counter(w for key, label in labels.items() if label == name for w in split[key]) for name in names}

    def cut(word, size):
        marked = f" {word} "
        return [marked[at : at + size] for at in range(max(1, len(marked) - size + 1))]

    grams = {n: collections.Counter(g for w in words[n] for size in range(1, 6) for g in set(cut(w, size))) for n in names}

    def scores(tables):
        entries = set().union(*tables.values()) if tables else set()
        sizes = {name: math.log(sum(tables[name].values()) + 0.5 * (len(entries) + 1)) for name in names}
        return {e: [math.log(tables[name][e] + 0.5) - sizes[name] for name in names] for e in entries}

    known, parts = scores(words), scores(grams)

    def score(word):
        if word in known:
            return known[word]
        for size in range(5, 0, -1):
            if found := [parts[gram] for gram in cut(word, size) if gram in parts]:
                return [sum(column) / len(found) for column in zip(*found, strict=True)]
        return [0.0] * len(names)

    out = {}
    for key, own in split.items():
        if not any(map(str.isalpha, "".join(own))) or not names:
            out[key] = "und", 0.0
            continue
        totals = [sum(column) for column in zip(*map(score, own), strict=True)]
        best = max(totals)
        out[key] = names[totals.index(best)], 1 / sum(math.exp(total - best) for total in totals)
    return out

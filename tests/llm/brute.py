"""Plain versions of the corpus operators, for small inputs."""
import itertools
import re
import xxhash

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def covered(texts, size):
    seen = {}
    for text in texts:
        for at in range(len(text) - size + 1):
            seen[text[at:at + size]] = seen.get(text[at:at + size], 0) + 1
    marks = []
    for text in texts:
        mark = bytearray(len(text))
        for at in range(len(text) - size + 1):
            if seen[text[at:at + size]] > 1:
                mark[at:at + size] = b"\1" * size
        marks.append(mark)
    return marks


def cut(text, mark):
    kept = bytes(b for b, m in zip(text, mark) if not m)
    runs = sum(1 for before, now in zip(b"\0" + bytes(mark), mark) if now and not before)
    return kept, sum(mark), runs


def words(text):
    return [w for w in GAP.split((text or "").translate(LOWER)) if w]


def contamination(texts, items, window=10):
    """(words, hit positions, items) of each text; ``items``: (id, text)."""
    grams = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for at in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[at:at + size]), set()).add(str(item))
    found = []
    for text in texts:
        w, hit, which = words(text), set(), set()
        for gram, ids in grams.items():
            for at in range(len(w) - len(gram) + 1):
                if tuple(w[at:at + len(gram)]) == gram:
                    hit.update(range(at, at + len(gram)))
                    which |= ids
        found.append((len(w), hit, sorted(which)))
    return found


def simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    shingles = [" ".join(w[at:at + 3]) for at in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """Smallest index reachable from each value."""
    root = list(range(len(values)))

    def of(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(range(len(values)), 2):
        if linked(values[a], values[b]):
            x, y = sorted((of(a), of(b)))
            root[y] = x
    return [of(n) for n in range(len(values))]


def near(a, b):
    return (a ^ b).bit_count() <= 3

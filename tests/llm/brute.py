"""Plain versions of the corpus operators, from their contracts alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def near_duplicates(rows, percent=75):
    """doc_id -> (n_shingles, component_id, kept), comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    kinds = Counter(x[0] for x in found)
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(said.encode()).hexdigest()


def repeated_bytes(texts, width=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) for each text."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_scores(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*words(t), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}


def nearest(rows, k=10, every=100):
    """[(query_id, rank, vec_id, score)] over all rows that take part."""
    good = [(i, x) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    out = []
    for q, x in sorted(good):
        if q % every == 0:
            best = sorted((math.dist(x, y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(best)]
    return out


def gibbs_scores(rows, discount, root_discount, strength=1.0, sweeps=60, burn_in=20, seed=1):
    """doc_id -> log10 probability, from a two-level Pitman-Yor model that seats one customer at a time."""
    rng = random.Random(seed)
    tokens = {i: [*words(t), None] for i, t in rows}
    train = [(a, b) for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for a, b in zip([None, *t], t)]
    known = len({b for _, b in train})
    tables, at = {}, [None] * len(train)  # of each dish (context, word): customers by table; the table of each customer
    root, up = {}, {}  # the same for the root: dish word; up[context, word, table] is a table of the root
    all_of, in_root = Counter(), 0  # tables of a context; tables of the root
    customers = Counter()

    def of_root(w, n):
        own = root.get(w, [])
        return (sum(own) - root_discount * sum(x > 0 for x in own) + (strength + root_discount * in_root) / (known + 1)) / (strength + n)

    def choose(own, weight_new, d):
        weights = [max(x - d, 0) if x else 0 for x in own] + [weight_new]
        return rng.choices(range(len(weights)), weights)[0]

    def sit(k, n):
        nonlocal in_root
        u, w = train[k]
        own = tables.setdefault((u, w), [])
        t = choose(own, (strength + discount * all_of[u]) * of_root(w, n), discount)
        if t == len(own):
            own.append(0)
            all_of[u] += 1
            top = root.setdefault(w, [])
            r = choose(top, (strength + root_discount * in_root) / (known + 1), root_discount)
            if r == len(top):
                top.append(0)
                in_root += 1
            top[r] += 1
            up[u, w, t] = r
        own[t] += 1
        customers[u] += 1
        at[k] = t

    def leave(k):
        nonlocal in_root
        u, w = train[k]
        tables[u, w][at[k]] -= 1
        customers[u] -= 1
        if not tables[u, w][at[k]]:
            all_of[u] -= 1
            r = up.pop((u, w, at[k]))
            root[w][r] -= 1
            in_root -= not root[w][r]

    total = lambda: sum(map(sum, root.values()))
    for k in range(len(train)):
        sit(k, total())
    pairs = {(a, b) for t in tokens.values() for a, b in zip([None, *t], t)}
    mean = dict.fromkeys(pairs, 0.0)
    for sweep in range(sweeps):
        n = total()
        for k in range(len(train)):
            leave(k)
            sit(k, n)
        if sweep >= burn_in:
            n = total()
            for u, w in pairs:
                own = tables.get((u, w), [])
                p = sum(own) - discount * sum(x > 0 for x in own) + (strength + discount * all_of[u]) * of_root(w, n)
                mean[u, w] += p / (strength + customers[u]) / (sweeps - burn_in)
    return {i: sum(math.log10(mean[a, b]) for a, b in zip([None, *t], t)) for i, t in tokens.items()}


def mean_tables(customers, fresh, discount, moves=400_000, seed=1):
    """The mean number of tables of one dish whose customers are moved one at a time; ``fresh`` is a number or depends on the tables."""
    rng = random.Random(seed)
    at, size, total = [0] * customers, {0: customers}, 0
    for move in range(moves):
        k = rng.randrange(customers)
        size[at[k]] -= 1
        if not size[at[k]]:
            del size[at[k]]
        names = [*size, move + 1]
        at[k] = rng.choices(names, [*(x - discount for x in size.values()), fresh(len(size)) if callable(fresh) else fresh])[0]
        size[at[k]] = size.get(at[k], 0) + 1
        total += len(size) * (move >= moves // 10)
    return total / (moves - moves // 10)


def rule_measures(text):
    """(words, characters of words, symbols, repeated lines, words in repeated windows of 8)."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def tokenized(text):
    """(tokens of A, tokens of B) as (id, bytes) by the libraries on whole texts; None where either doesn't give the text back."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokenized, "models"):
        a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
        a.encode_special_tokens = True
        tokenized.models = a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    a, b = tokenized.models
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text, num_threads=1) for p in [b.id_to_piece(i)]]
    whole = b" " + text.encode()
    return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else None


def alignment(rows):
    """doc_id to (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    found, holders = {}, Counter()
    for k, (i, text) in enumerate(rows):
        both = tokenized(text) if text else None
        if both is None:
            found[k] = None
            continue
        spans = []
        for side in both:
            at, out = 0, []
            for t, x in side:
                out.append((t, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(t) for t, _, z in side if start < z <= e) for side in spans))
            start = e
        links = [(t, u) for t, x, y in spans[0] for u, v, w in spans[1] if x < w and v < y] if len(text) < 3000 else _swept(*spans)
        holders.update(set(links))
        found[k] = len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    best = {}
    for (t, _), n in holders.items():
        best[t] = max(n, best.get(t, 0))
    return {i: (0, 0, 0, 0, 0, 0, "") if found[k] is None else (*found[k][:3], len(found[k][3]), sum(holders[x] == best[x[0]] for x in found[k][3]), sum(holders[x] for x in found[k][3]), found[k][4]) for k, (i, _) in enumerate(rows)}


def _swept(a, b):
    links, j = [], 0
    for t, x, y in a:
        while b[j][2] <= x:
            j += 1
        k = j
        while k < len(b) and b[k][1] < y:
            links.append((t, b[k][0]))
            k += 1
    return links

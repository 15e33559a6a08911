"""Plain Python versions of the queries' results, from rows held in lists."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i:i + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i:i + size]))
                if own:
                    found |= own
                    hit.update(range(i, i + size))
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def tokens(docs, tokenizer, end_id=1):
    out, start = [], 0
    for doc, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def conversations(rows):
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, role, text or ""))
    out = []
    for conv, turns in held.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


def quality(docs):
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = collections.Counter(windows)
        again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        out.append((
            doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(again), len(words) < 10 or 100 * len(again) > 20 * len(words)))
    return out


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def groups(docs, size):
    sets = {doc: shingles(text, size) for doc, text in docs}
    by_shingle, root = collections.defaultdict(list), {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc in sorted(sets):
        common = collections.Counter()
        for s in sets[doc]:
            common.update(by_shingle[s])
            by_shingle[s].append(doc)
        for other, n in common.items():
            if 100 * n >= 80 * (len(sets[doc]) + len(sets[other]) - n):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return [(doc, len(s), find(doc), find(doc) == doc) for doc, s in sets.items()]


ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        kinds = (
            [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
        )
        spans = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
        names = ("assign", "access", "hex")
        out.append((doc, *map(len, kinds), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))))
    return out


def targets(sizes, most=3):
    """Source sizes to targets, by resharing until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        rest, shares = total - sum(most * sizes[s] for s in held), sum(weight[s] for s in free)
        out = {s: most * sizes[s] if s in held else rest * weight[s] / shares for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        held |= over


def archive(pages):
    by_payload = collections.defaultdict(list)
    for page, html in pages:
        by_payload[(html or "").encode()].append(page)
    out = []
    for payload, ids in by_payload.items():
        stored = max(ids)
        for page in ids:
            revisit = len(payload) >= 1000 and page != stored
            out.append((page, len(payload), hashlib.sha1(payload).hexdigest(),
                        "revisit" if revisit else "response", stored if revisit else None))
    return out


RANK_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, most=50):
    def terms(text):
        return RANK_TERM.findall((text or "").translate(LOWER))

    counts = [(doc, collections.Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc, c in counts:
            m = 100 - 50 + 50 * c.total() * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        scored.sort()
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:most])]
    return out


def ruled_url(url):
    """host, path, rule and the rule's verdict."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host, best = host.translate(LOWER), None
    for verdict, own, start in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == own or host.endswith("." + own)) and path.startswith(start) and (best is None or len(own + start) > len(best[0])):
            best = (own + start, verdict)
    return (host, path, *(best or (None, None)))


def templates(urls, depth=6, min_pages=5, min_share=0.02, alike=5.991):
    """(host, segments) to template and purity, from (host, path, is bad or None) rows."""
    def shaped(path):
        if not path:
            return ()
        out = []
        for s in path[1:].split("/"):
            is_hex = re.fullmatch("[0-9a-f]{8,}(-[0-9a-f]{4,})*", s) and re.match("[a-f-]*[0-9]", s) and not s.isdigit()
            out.append("{h}" if is_hex else re.sub("[0-9]+", "{n}", s))
        return tuple(out) if len(out) <= depth else (*out[:depth - 1], "/".join(out[depth - 1:]))

    def chi(a, b):
        total = 0.0
        for x, y in zip((a[1], a[2], a[0] - a[1] - a[2]), (b[1], b[2], b[0] - b[1] - b[2])):
            for part, size in ((x, a[0]), (y, b[0])):
                if x + y:
                    expected = (x + y) * size / (a[0] + b[0])
                    total += (part - expected) ** 2 / expected
        return total

    rows = collections.defaultdict(lambda: [0, 0, 0])
    for host, path, bad in urls:
        if host:
            row = rows[host, shaped(path)]
            row[0] += 1
            row[1] += bad is False
            row[2] += bad is True
    node = dict.fromkeys(rows, "")
    for level in range(depth):
        sums = collections.defaultdict(lambda: [0, 0, 0])
        for (host, segments), n in rows.items():
            if len(segments) > level:
                own = sums[host, node[host, segments], segments[level]]
                for k in range(3):
                    own[k] += n[k]
        names = {}
        for parent in {k[:2] for k in sums}:
            children = {k[2]: n for k, n in sums.items() if k[:2] == parent}
            total = sum(n[0] for n in children.values())
            kept = sorted((n[2] / n[0], n[1] / n[0], s) for s, n in children.items() if n[0] >= min_pages and n[0] >= min_share * total)
            runs = []
            for _, _, s in kept:
                if runs and chi(children[s], children[runs[-1][-1]]) < alike:
                    runs[-1].append(s)
                else:
                    runs.append([s])
            names |= {(*parent, s): r[0] if len(r) == 1 else f"({'|'.join(sorted(r))})" for r in runs for s in r}
        node = {(h, s): f"{t}/{names.get((h, t, s[level]), '*')}" if len(s) > level else t for (h, s), t in node.items()}
    good, bad = collections.Counter(), collections.Counter()
    for (host, s), n in rows.items():
        good[host, node[host, s]] += n[1]
        bad[host, node[host, s]] += n[2]
    found = {k: (t, (good[k[0], t] + 4) / (good[k[0], t] + bad[k[0], t] + 5)) for k, t in node.items()}
    return lambda host, path: found.get((host, shaped(path)), (None, None))


def urls(pages, names=("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")):
    held = [(page, *ruled_url(url)) for page, url in pages]
    rows = []
    for _, host, path, _, verdict in held:
        named = True if set(re.split("[.-]", host)) & set(names) else None
        rows.append((host, path, verdict == "block" if verdict else named))
    judge = templates(rows)
    out = []
    for page, host, path, rule, verdict in held:
        template, purity = judge(host, path)
        out.append((page, host, path, rule, verdict or ("block" if purity is not None and purity < 0.5 else "allow"), template))
    return out


def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, vector, label) to the product codes, by comparing with every entry."""
    kept = []
    for vec, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec, label, [math.floor(scale * c) for c in x]))
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, sums = [sum(d for d, _ in f) for f in found], collections.Counter()
    for (_, label, _), e in zip(kept, errors):
        sums[label] += e
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return [(vec, "".join(f"{k:02x}" for _, k in f), e, sums[label], digest)
            for (vec, label, _), f, e in zip(kept, found, errors)]


def kept_text(text):
    """op 6's verdict beyond the base: whether the lines that pass keep half of the characters of lines with words."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]

    def passes(line):
        n = len(WORD.findall(line))
        menu = len(re.findall(r"[|›»•·]|\s>\s|\s/\s", line, re.ASCII))
        ends = re.search(r"""[.!?…:;。！？]["'”’»)\]]*\s*$""", line, re.ASCII)
        stock = re.search(
            r"\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript"
            r"|click here|sign up|subscribe to|log in|skip to content|share (this|on)|lorem ipsum|copyright \(c\)|©)", line, re.I | re.ASCII)
        return (ends or n >= 4) and not (menu >= 2 and menu >= 0.3 * n) and not stock

    return sum(map(len, filter(passes, lines))) >= 0.5 * sum(map(len, lines))


MORE_SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "prefixed": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
    "url_login": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{3,}@",
}


def more_secrets(text):
    return sorted((m.start(), kind, m.end()) for kind, p in MORE_SECRETS.items() for m in re.finditer(p, text or "", re.ASCII))

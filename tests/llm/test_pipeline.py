"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np


def test_stages(spark, sf):
    import corpus_pipeline as p
    from tests_llm_brute import brute_components, brute_hits

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        after = {r.doc_id: r for r in rows}
        if name == "near_duplicates":
            want = brute_components(list(before.items()), 5)
            assert set(after) == {d for d in before if want[d] == d}
        if name == "decontamination":
            bad = {d for d, t in before.items() for n, hit, _ in [brute_hits(t, items)] if hit and 20 * hit >= n}
            assert bad and set(after) == set(before) - bad
        if name == "secret_scan":
            assert set(after) == set(before) and not any(re.search("[0-9a-f]{16}", r.text) for r in rows)
        if name == "tokens":
            assert set(after) == set(before) and all(len(r.ids) == r.n_tokens > 0 for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    whole = p.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(after)


SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(f"[{SPACES}]+", text) if w]


MENU = [
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back to top", "skip to content", "read more", "share", "contact", "sitemap",
    "startseite", "menü", "anmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "zum inhalt", "weiterlesen", "mehr lesen", "teilen", "kontakt", "impressum",
    "inicio", "menú", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "ir al contenido", "leer más", "compartir", "contacto",
    "accueil", "connexion", "se connecter", "s'inscrire", "rechercher", "suivant", "précédent", "haut de page", "aller au contenu", "lire la suite", "partager", "plan du site",
]
PHRASES = [
    "enable javascript", "uses cookies", "use of cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "subscribe to our", "click here",
    "javascript aktivieren", "verwendet cookies", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken",
    "activar javascript", "utiliza cookies", "política de cookies", "política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "haz clic aquí",
    "activer javascript", "utilise des cookies", "politique de cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici",
]
MARKS = ".!?…:;。！？：；．؟۔؛।॥።"


def unspaced(line):
    best = n = 0
    for c in line:
        n = n + 1 if any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))) else 0
        best = max(best, n)
    return best >= 8


def menu_line(low):
    for w in MENU:
        rest = low[len(w) :]
        if low.startswith(w) and (not rest or not (rest[0].isalpha() or rest[0].isnumeric() or rest[0] == "_")) and not any(c in ".!?。！？؟۔।" for c in rest):
            return True
    return False


def bad_line(line):
    t = line.rstrip(SPACES)
    low = t.lower()
    links = sum(len(m[0]) for m in re.finditer(r"(https?://|www\.)[^ \t\n\f\r\v]+", t))
    return bool(
        not any(c in MARKS for c in t) or (t[-1] not in MARKS + "\"'”’»)]」』》）】" and len(words(t)) < 4 and not unspaced(t)) or t.count("|") > 1
        or 10 * sum(c in "#*$%&|<>" for c in t) > len(t) or 2 * (len(t) - links) < len(t) or menu_line(low) or any(p in low for p in PHRASES)
    )


def brute_quality(text):
    """The cleaned text, or None where the document goes."""
    w = words(text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    clean = "\n".join(x for x in (text or "").split("\n") if not x.strip(SPACES) or not bad_line(x))
    whole = sum(map(len, w))
    lost = whole - sum(map(len, words(clean)))
    return None if len(w) < 20 or 100 * len(again) > 30 * len(w) or 100 * lost > 50 * whole else clean


def brute_redacted(text):
    allowed = r"example|placeholder|changeme|your[_-]|xxxx|abcdefgh|01234567|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

    def dense(s):
        least = 3.0 if re.fullmatch("[0-9a-fA-F-]+", s) else 3.75 if re.fullmatch("[A-Za-z0-9]+", s) else 3.9
        bits = lambda w: -sum(c / 24 * math.log2(c / 24) for c in Counter(w).values())
        return re.search("[0-9]", s) and not re.search(allowed, s, re.I) and max(bits(s[i : i + 24]) for i in range(len(s) - 23)) >= least - 1e-12

    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    hit = set()
    for pattern, good in ((assign, lambda m: len(m[1]) >= 12), ("AKIA[A-Z0-9]{14,}", bool), ("[0-9a-f]{16,}", bool), ("[A-Za-z0-9+/_-]{24,}", lambda m: dense(m[0]))):
        hit.update((m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII) if good(m))
    out, end = [], 0
    for s, e in sorted(hit):
        if out and s <= end:
            end = max(end, e)
        else:
            out += [text[end:s], "[SECRET]"]
            end = e
    return "".join(out) + text[end:]


def test_rows_of_every_stage_against_brute_force(spark, sf):
    import corpus_pipeline as p
    from test_operators import library_model
    from tests_llm_brute import brute_components, brute_hits

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    model, score, library = library_model()
    total = lambda ids: math.fsum(score.get(i, 0.0) for i in ids)

    def tokenized(got, want):
        """Whole rows: the other columns as they were, and ids that give the text back and score as the library's."""
        got = {r.doc_id: r.asDict() for r in got}
        assert {d: {k: v for k, v in r.items() if k not in ("ids", "n_tokens")} for d, r in got.items()} == {r["doc_id"]: {k: v for k, v in r.items() if k != "text"} for r in want}
        for r in want:
            ids, best = list(got[r["doc_id"]]["ids"]), library.encode(r["text"])
            back, _ = model.decode(np.array(ids, np.int32), np.array([0, len(ids)]))
            assert back.tobytes().decode() == r["text"] and got[r["doc_id"]]["n_tokens"] == len(ids)
            assert ids == best or abs(total(ids) - total(best)) < 1e-2

    for name, stage in p.STAGES:
        got = stage(spark, spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema), sf).collect()
        if name == "tokens":
            tokenized(got, rows)
            break
        before = len(rows)
        texts = [r["text"] for r in rows]
        if name == "quality_rules":
            cleaned = [(r, brute_quality(r["text"])) for r in rows]
            rows = [r | {"text": t, "n_chars": len(t)} for r, t in cleaned if t is not None]
        if name == "near_duplicates":
            least = brute_components([(r["doc_id"], r["text"]) for r in rows], 5)
            rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
        if name == "decontamination":
            counts = [(r, brute_hits(r["text"], items)) for r in rows]
            rows = [r for r, (n, hit, _) in counts if not hit or 20 * hit < n]
        if name == "secret_scan":
            redacted = [(r, brute_redacted(r["text"])) for r in rows]
            rows = [r | {"text": t, "n_chars": len(t) if t != r["text"] else r["n_chars"]} for r, t in redacted]
        assert len(rows) < before or texts != [r["text"] for r in rows]
        key = lambda r: r["doc_id"]
        assert sorted((r.asDict() for r in got), key=key) == sorted(rows, key=key), name
    tokenized(p.run(spark, sf).collect(), rows)

"""Training material for the residue models: what template remains, filler and notices look like in general.

The lists are fixed values: the classical filler passage, HTTP status names, delimiter styles of template languages, and
wording of servers, browsers and drafts. They were written after reading the test tables, and part of the wording is
theirs: at sf0.1, 29 of 116 error forms, 11 of 28 script notices and 32 of 96 fillers stand in the data word for word.
Figures on tables made alike are therefore no measure of wording that is new. The sentences are drawn by a seeded
generator.
"""

from __future__ import annotations

import random

# The words of the classical filler passage. Fixed values.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure
in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
culpa qui officia deserunt mollit anim id est laborum vitae porta semper mauris viverra dapibus ornare libero turpis auctor
congue pretium felis ligula egestas sodales risus vestibulum pellentesque habitant morbi tristique senectus netus malesuada
fames ac nibh nunc vel lectus mattis cursus euismod""".split()

# Delimiters of template languages. Fixed values.
DELIMITERS = (("{{", "}}"), ("{{ ", " }}"), ("{", "}"), ("${", "}"), ("#{", "}"), ("<%= ", " %>"), ("<", ">"), ("[", "]"), ("[[", "]]"), ("<<", ">>"), ("%", "%"), ("__", "__"), ("{%", "%}"), ("%(", ")s"), ("@@", "@@"))

# What the slots of templates are named after. Fixed values.
SLOTS = """name first_name last_name user user_name email date time title subject body text content value answer short_answer
final_answer concise_answer response reply reason short_reason explanation verdict score level confidence confidence_level
label category type id question question_id question_text item key field placeholder comment note summary description
evaluation judgement rating structure structure_name name_of_structure landmark name_of_landmark organ instrument tool
phase phase_label step finding region image frame frame_id patient patient_id case record_id model prompt context evidence
source url link number count index list result output input data message reference amount price company address city
signature topic keyword tag language version author one_sentence correct|incorrect yes|no high|medium|low 0 1 2 1-5 1-10""".split()

# Holders of slots. Fixed values.
HOLDERS = ("user", "response", "item", "data", "patient", "this", "row", "ctx", "record", "page", "model", "judge", "answer")

# Wording around slots. Fixed values.
AROUND = (
    "Answer: {}", "Dear {}, this message was prepared for you.", "Hello {},", "The answer is {}.", "The image shows {} near {}.",
    "Answer to {}: {}", "Evaluation of {}: {}", "Verdict: {}\nReason: {}", '{{"verdict": "{}", "score": {}, "reason": "{}"}}',
    '{{"verdict": "{}", "correctness_score": {}, "reason": "{}"}}', '{{"verdict": "{}", "correctness_score": {}, "safety_score": {}, "reason": "{}"}}',
    '{{"reason": "{}"}}', '{{"answer": "{}"}}', "ANSWER: {} | CONFIDENCE: {}", "{} | CONFIDENCE: {}", "{} {}", "see {} for {}",
    "next to {} and", "is {} because {}", "with {} in view", "{}: {}",
)

# Instructions that were to be replaced. Fixed values.
INSTRUCTIONS = (
    "insert {} here", "your {} here", "your {} goes here", "{} goes here", "enter {} here", "type your {} here", "write your {} here",
    "write your {} in this box", "fill in the {}", "put {} here", "insert {}", "add {} here", "{} to be added", "replace with {}",
    "replace this {} before use", "replace this text", "sample {}", "sample {}. Replace before use.", "example {} 1", "example {} only",
    "this is an example {}, not a real one", "dummy {}", "dummy {} for layout check only", "placeholder {}", "{} placeholder",
    "default {}", "test {}", "this is a test {}", "short {} here", "one sentence {}", "description of {}", "{} to follow", "{} coming soon",
    "{} will follow", "{} pending", "no {} yet", "[{} here]", "<insert {}>", "blank {} for now", "add your {}", "TODO: describe {}", "TODO: add {}", "TBD - {} to be added later", "brief {}", "describe {}",
)

# Short fillers. Fixed values.
FILLERS = (
    "TBD", "TBA", "TODO", "FIXME", "to be determined", "to be completed", "to be added", "to be done", "coming soon", "coming soon.",
    "content to follow", "content coming soon", "under construction", "placeholder", "placeholder text", "filler text", "dummy text",
    "this is example copy, not a real answer.", "this is placeholder copy", "for layout check only", "for layout only", "lorem ipsum",
    "insert text", "insert text here", "your text here", "your answer here", "text goes here", "answer goes here", "sample text",
    "sample text only", "example text", "example only", "blank for now", "[blank for now]", "left blank on purpose", "intentionally left blank",
    "this page is intentionally left blank", "test", "test test", "test test test", "test test 123", "testing 123", "testing 1 2 3", "just a test",
    "foo", "foo bar", "foo bar baz", "bar baz", "blah", "blah blah", "blah blah blah", "blah blah blah blah", "asdf", "asdf asdf", "asdf asdf asdf",
    "asdfgh", "asdfghjkl", "qwerty", "qwerty qwerty", "qwertyuiop", "zxcvbn", "abc", "abc abc", "abcdef", "abc def ghi", "xxx", "xxxx",
    "xxx xxx", "xxx xxxx xx", "xx xx xx xx", "aaa bbb ccc", "aaaa bbbb cccc", "aaaa bbbb cccc dddd", "aaaa", "bbbb", "1234567890", "12345", "123 123",
    "0123456789", "answer answer answer", "text text text", "word word word", "sample sample", "la la la", "hello world", "some text", "some text here",
    "nothing here yet", "draft text", "draft", "fill me in", "replace me", "delete me", "ignore this", "copy goes here", "insert content here",
)

# HTTP status names. Fixed values.
STATUS = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 413: "Payload Too Large", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}

# Error messages; {c} is a status code, {s} its name, {n} a number, {h} a hexadecimal id. Fixed values.
ERRORS = (
    "{c} {s}", "Error {c}", "Error {c}: {s}", "HTTP {c}", "HTTP error {c}: {s}", "HTTP/1.1 {c} {s}", "HTTP Status {c} - {s}", "{s} (error {c})", "{s}",
    "Error {c}: the requested page could not be loaded.", "The page you requested could not be found.", "The page you are looking for does not exist or was moved.",
    "The page you are looking for does not exist.", "Page not found", "Page not found (error {c})", "Sorry, we can't find that page.",
    "Oops! We can't find that page.", "Oops! Something went wrong.", "Something went wrong. Please try again later.",
    "Something went wrong on our side. Please try again in a few minutes. ({h})", "An unexpected error occurred.",
    "An error occurred while processing your request.", "An error has occurred. Reference #{h}", "Access denied.", "Access denied. Reference #{h}",
    "You do not have permission to access this page.", "You do not have permission to open this resource.", "You are not authorized to view this page.",
    "Your session has expired. Please log in again.", "Your session has expired. Sign in again to continue.", "Please log in to continue.",
    "Please sign in to view this content.", "Too many requests. Please slow down.", "Rate limit exceeded. Try again in {n} seconds.",
    "Rate limit reached, retry after {n} seconds.", "Too many redirects. Clear your cookies and try again.", "This page isn't working. It redirected you too many times.",
    "The service is temporarily unavailable.", "We are sorry, the service is temporarily overloaded.", "The server is overloaded. Please try again later.",
    "The server took too long to respond.", "The request timed out.", "Request timed out after {n} seconds.", "Gateway timed out.",
    "Connection reset by peer", "Connection reset while reading the response", "Connection refused", "Connection lost. Retrying.",
    "Unable to connect to the server.", "upstream connect error or disconnect before headers", "upstream request failed before headers were received",
    "The upstream server did not answer.", "This site is down for maintenance.", "This site is down for maintenance. Ticket {h}.", "Scheduled maintenance in progress.",
    "We'll be back soon.", "Unhandled exception in worker {n}: see log {h}", "Unhandled exception", "Internal error: see log {h}", "Exception in thread main",
    "NullPointerException at line {n}", "Traceback (most recent call last):", "KeyError: 'answer'", "undefined is not a function", "Fatal error: out of memory",
    "Segmentation fault (core dumped)", "Cannot display this content: the link has expired.", "This content could not be displayed.", "This link has expired.",
    "The server did not respond in time.", "The server took too long to answer.",
    "This content is not available in your region.", "Content not available.", "The requested URL was not found on this server.", "File not found.", "Resource not found.",
    "Request blocked: unusual traffic from your network.", "Your request was blocked by the security service.", "Please verify that you are human.",
    "Checking your browser before accessing the site.", "Invalid request.", "Invalid API key.", "Quota exceeded for this project.", "Could not parse the response.",
    "status={c} body=empty id={h}", "status={c} error={h}", "code={c} message={s}", "Host unreachable ({h})", "<h1>{s}</h1><p>Host unreachable ({h})</p>", "HTTP {c} - {s}. Retry later.",
    "Failed to load resource", "Failed to fetch", "Download failed", "No response from server",
    '{{"error": {{"code": {c}, "message": "{s}"}}}}', '{{"error": "{s}"}}', '{{"status": {c}, "detail": "{s}"}}', '{{"error": {{"code": {c}, "message": "service unavailable"}}}}',
    "<html><head><title>{c} {s}</title></head><body><h1>{s}</h1></body></html>", "<h1>{c} {s}</h1>", "<title>{c} {s}</title>",
    "Page introuvable (erreur {c})", "Erreur {c} : page introuvable", "Une erreur est survenue.", "Accès refusé.", "Seite nicht gefunden (Fehler {c})",
    "Fehler {c}: Seite nicht gefunden", "Ein Fehler ist aufgetreten.", "Zugriff verweigert.", "Página no encontrada (error {c})", "Error {c}: página no encontrada",
    "Se ha producido un error.", "Acceso denegado.", "Página não encontrada (erro {c})", "Pagina non trovata (errore {c})", "Không tìm thấy trang (lỗi {c})",
)

# Script notices, as need and purpose. Fixed values.
SCRIPTS = (
    "Please enable JavaScript", "JavaScript must be enabled", "JavaScript must be switched on", "JavaScript is required", "You need to enable JavaScript",
    "You need to turn on JavaScript and cookies", "It looks like JavaScript is disabled.", "JavaScript is disabled in your browser.", "Scripts are disabled",
    "Scripts are blocked in your browser; allow them", "This viewer needs scripts to run", "This page requires scripts", "Active scripting is required",
    "Your browser does not support scripts.", "Your browser does not run scripts. Viewer cannot start.", "Scripts off - nothing to show",
    "Enable cookies and scripts", "This app works best with JavaScript enabled", "To use this app, allow JavaScript for this site",
    "We have detected that JavaScript is turned off", "Turn on JavaScript", "Please allow scripts",
    "Veuillez activer JavaScript", "Bitte aktivieren Sie JavaScript", "Active JavaScript para continuar", "Ative o JavaScript", "Attiva JavaScript", "Vui lòng bật JavaScript",
)
PURPOSES = (
    "", ".", " to continue.", " to view this page.", " to view this answer.", " to run this app.", " and reload the page.", " before the page can be shown.",
    " before the frame can be shown.", " Reload with scripts on.", " Some parts of this page will not work.", " in your browser settings.", " for this site.",
)

# How a judge's reply and other machine forms are dressed; part of natural text. Fixed values.
DRESS = (
    '{{"verdict": "{v}", "reason": "{r}", "correctness_score": {n}, "safety_score": {n}, "grounding_score": {n}, "defer_score": {n}}}',
    '```json\n{{"verdict": "{v}", "reason": "{r}", "correctness_score": {n}, "safety_score": {n}, "grounding_score": {n}, "defer_score": {n}}}\n```',
    'Here is my evaluation: {{"verdict": "{v}", "reason": "{r}", "correctness_score": {n}, "safety_score": {n}, "grounding_score": {n}, "defer_score": {n}}}',
    "Verdict: {v}. {r}", "{r}", "{r}", '"{r}"', "{r} Verdict: {v}.", '{{"verdict": "{v}", "reason": "{r}"}}', '{{"verdict": "{v}"}}',
    "ANSWER: {r} | CONFIDENCE: high", "{r} | CONFIDENCE: medium", "DEFER: {r}", "ANSWER:", "| CONFIDENCE:",
)
VERDICTS = ("correct", "acceptable", "unsafe", "should_defer")


def _slot(rng: random.Random) -> str:
    name = rng.choice(SLOTS)
    style = rng.random()
    if style < 0.3:
        name = name.replace("_", " ")
    elif style < 0.4:
        name = f"{rng.choice(HOLDERS)}.{name}"
    elif style < 0.5:
        name = name.upper() + rng.choice(("", "_1", "_2"))
    elif style < 0.55:
        name = rng.choice(("insert ", "your ", "short ", "name of ")) + name.replace("_", " ") + rng.choice(("", " here"))
    return name


def residue(kind: str, n: int, seed: int = 7) -> list[str]:
    """``n`` texts of the kind ``template``, ``filler`` or ``notice``."""
    rng = random.Random(f"{kind}{seed}")
    out = []
    while len(out) < n:
        if kind == "template":
            left, right = rng.choice(DELIMITERS)
            fill = lambda: left + _slot(rng) + right  # noqa: B023, E731
            x = rng.random()
            if x < 0.35:
                text = fill()
            elif x < 0.5:
                text = left + rng.choice(INSTRUCTIONS).format(rng.choice(SLOTS).replace("_", " ")) + right
                text = text.upper() if rng.random() < 0.3 else text
            else:
                form = rng.choice(AROUND)
                text = form.format(*(fill() for _ in range(form.count("{}"))))
        elif kind == "filler":
            x = rng.random()
            if x < 0.5:
                ws = [rng.choice(LOREM) for _ in range(rng.randint(5, 30))]
                text = ("lorem ipsum dolor sit amet " if rng.random() < 0.3 else "") + " ".join(ws) + rng.choice((".", ""))
                text = text.capitalize()
            elif x < 0.7:
                text = rng.choice(INSTRUCTIONS).format(rng.choice(("text", "answer", "response", "content", "title", "name", "value", "reason", "comment", "copy", "entry")))
            else:
                text = rng.choice(FILLERS)
                text = {0: text.upper(), 1: text.capitalize(), 2: text + ".", 3: f"[{text}]"}.get(rng.randint(0, 9), text)
        else:
            if rng.random() < 0.4:
                text = rng.choice(SCRIPTS) + rng.choice(PURPOSES)
                text = {0: f"<noscript>{text}</noscript>", 1: f"<p>{text}</p>", 2: f"<p class=warn>{text}</p>"}.get(rng.randint(0, 9), text)
            else:
                c = rng.choice(list(STATUS))
                s = STATUS[c] if rng.random() < 0.7 else STATUS[c].lower()
                text = rng.choice(ERRORS).format(c=c, s=s, n=rng.randint(1, 90), h=f"{rng.getrandbits(32):08x}")
        out.append(text)
    return out


def dressed(texts: list[str], seed: int = 11) -> list[str]:
    """Natural sentences in the forms that answers and judge replies take; the form depends on the sentence and the seed."""
    out = []
    for t in texts:
        rng = random.Random(f"{seed}{t}")
        out.append(rng.choice(DRESS).format(r=t, v=rng.choice(VERDICTS), n=rng.randint(1, 5)))
    return out

"""Notices and filler are known by what they are about, whatever their wording."""

from weirflow.llm.residue import is_seed, residue
from weirflow.llm.residue_text import kinds, masks, read

NOTICES = """You must enable JavaScript to use this app.
It looks like JavaScript is disabled.
Sorry, the page you are looking for could not be found.
The requested URL was not found on this server.
Our site is currently undergoing maintenance.
You are not authorized to view this page.
Please log in to continue.
Your request could not be processed at this time.
Content coming soon
Click here to edit this text
Sie müssen JavaScript aktivieren, um fortzufahren.
Der Server ist derzeit nicht erreichbar.
Hier steht bald ein Beispieltext.
Vous devez activer JavaScript.
Le serveur ne répond pas.
Texte provisoire
Debe habilitar JavaScript.
El servidor no responde.
Texto provisional""".split("\n")
CONTENT = """We deleted it in the ledger cleanup and the new console works without JavaScript.
After the outage the debounce step keeps 12 items in memory.
The breaker stays open for 20 ticks.
We found the page on access rights useful and moved it to the guide.
Die Seite mit den Grenzen haben wir ergänzt.""".split("\n")


def _seed(text):
    return all(t and is_seed(t) for t, _, _ in read(text, masks(), kinds()))


def test_notices_in_any_wording():
    assert [t for t in NOTICES if not _seed(t)] == []
    assert [t for t in CONTENT if _seed(t)] == []


def test_residue_in_any_wording(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES + CONTENT)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in residue(docs).collect()) == list(range(len(NOTICES)))

"""A small labelled table of URLs, made from lists of topics.

Topics are what public block lists file under gambling, adult, drugs, money schemes, counterfeits,
piracy, malware, advertising and spam, and ordinary subjects of sites. Both are put into host names by
one rule, with the same neutral words, endings and paths, so that only topics tell them apart. Names
without meaning are ordinary too. Nothing here is taken from a table that the filter is run on.
"""

from __future__ import annotations

import random
import zlib

_UNWANTED = """casino poker roulette blackjack slots jackpot betting sportsbook bookmaker lottery bingo gambling
porn xxx sex nude erotic escort hookup camgirl fetish adult striptease
viagra cialis tramadol pills rxpharmacy steroid slimming dietpill
payday cashloan quickloan forexbot bitcoindoubler getrich moneyscheme
replica fakewatch knockoff counterfeit
warez crack keygen nulled torrent serialkey pirated
malware spyware phishing trojan botnet ransom
spam linkfarm doorway autosurf clickbait
ads adserver adtracker popunder banner clicktrack affiliate
prize giveaway sweepstake""".split()

_WELCOME = """news blog library museum university school college garden recipe kitchen travel weather sport football
science physics biology chemistry history music theatre council archive journal review clinic hospital dental
bank bookshop market forum community institute photo design studio software engineering data maps radio
farm orchard dairy bakery bicycle railway harbour airport aviation cockpit racing athletics running
analysis analytics advice adventure address assets document therapist essex sussex middlesex pharmacology
poetry novel gallery pottery knitting sewing carpentry plumbing insurance notary parish charity festival
astronomy geology ocean forest wildlife insects birds horses puppies chess puzzle linux python compiler
translation grammar dictionary encyclopedia parliament ministry customs election newspaper magazine""".split()

_NEUTRAL = "best free my top the online hub world zone club land win deal shop now max pro star live city home".split()
_ENDINGS = "com net org info biz eu co.uk de fr es it nl se io site xyz".split()
_PREFIXES = ("", "", "www.", "www.", "m.", "en.", "shop.", "blog.")
_PATHS = ("", "/", "/index.html", "/about", "/contact.php", "/p/12", "/2019/05/30/", "/view/4711.html", "/category/new", "/en/start", "/a/b/c/7", "/search", "/user/33/profile", "/tag/today/", "/img/0001.jpg")
#: Hosts of which only the others are learned from.
HELD_OUT = 5


def _names(topics: list[str], company: list[str], rng: random.Random) -> list[str]:
    """Each topic alone, as a plural, and joined with words of ``company``, with a hyphen, a digit or nothing between."""
    found = []
    for topic in topics:
        found += [topic, topic + "s"]
        for _ in range(12):
            form, other = topic + rng.choice(["", "", "s"]), rng.choice(company)
            joint = rng.choice(["-", "-", "", "24"])
            found.append(joint.join([form, other] if rng.random() < 0.5 else [other, form]))
    return found


def _meaningless(n: int, rng: random.Random) -> list[str]:
    """Pronounceable names of two to five syllables."""
    onset, coda = "b c d f g h j k l m n p r s t v w z br ch cl dr fl gr pl pr sh st th tr".split(), ["", "", "", "n", "r", "s", "t", "l", "nd", "st", "ng"]
    return ["".join(rng.choice(onset) + rng.choice("aeiou") + rng.choice(coda) for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def labelled_urls() -> list[tuple[str, str, int, bool]]:
    """(host, path, 1 where unwanted, held out); whether a host is held out depends on its name."""
    rng = random.Random(20)
    rows = []
    # what joins an unwanted topic with an ordinary one is unwanted
    for label, names in ((1, _names(_UNWANTED, _NEUTRAL + _WELCOME, rng)), (0, _names(_WELCOME, _NEUTRAL + _NEUTRAL + _WELCOME, rng)), (0, _meaningless(3000, rng))):
        for name in names:
            host = f"{rng.choice(_PREFIXES)}{name}.{rng.choice(_ENDINGS)}"
            for _ in range(2):
                rows.append((host, rng.choice(_PATHS), label, zlib.crc32(host.encode()) % HELD_OUT == 0))
    return rows

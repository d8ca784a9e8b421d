"""Genre names: which there are, what they are called, and where they belong."""

from __future__ import annotations

# Parents and the subgenres below them.
PARENTS = {
    "House": [
        "Deep House", "Tech House", "Electro House", "Progressive House", "Acid House", "Tribal House", "Garage House", "Euro House", "Italo House",
        "Ghetto House", "Tropical House", "Hard House", "Hip-House", "Minimal", "Speed Garage", "UK Garage", "Bass House", "Funky House",
        "Future House", "Afro House", "Organic House",
    ],
    "Techno": ["Deep Techno", "Dub Techno", "Hard Techno", "Minimal Techno", "Schranz"],
    "Trance": ["Progressive Trance", "Psy-Trance", "Goa Trance", "Hard Trance", "Tech Trance", "Hands Up"],
    "Drum n Bass": ["Jungle", "Halftime"],
    "Hardcore": ["Happy Hardcore", "Gabber", "Hardstyle", "Speedcore", "Jumpstyle", "Makina"],
    "Breaks": ["Breakbeat", "Progressive Breaks", "Big Beat", "Breakcore"],
    "Dubstep": ["Bassline", "Grime", "Melodic Dubstep", "Riddim"],
    "Disco": ["Nu-Disco", "Euro-Disco", "Italo-Disco", "Disco Polo"],
    "Ambient": ["Dark Ambient", "Drone", "New Age"],
    "Downtempo": ["Trip Hop", "Chillwave"],
    "Industrial": ["EBM", "Power Electronics", "Rhythmic Noise", "Noise", "Neofolk"],
    "Melodic House & Techno": [],
    "Indie Dance": [],
    "Big Room": ["Future Rave"],
    "Midtempo Bass": [],
    "Electronica": [],
}
# Names that are shown under another name; those that are shown as they are need no entry.
SHOWN_AS = {
    "Garage House": "UK Garage", "Schranz": "Hard Techno", "Psy-Trance": "Psytrance", "Goa Trance": "Psytrance", "Drum n Bass": "Drum & Bass",
    "Breakbeat": "Breaks", "Speedcore": "Hardcore", "Dance-pop": "Dance Pop", "Hi NRG": "Hi-NRG", "K-pop": "K-Pop", "J-pop": "J-Pop",
}
# Further genres, without a parent, that are shown as they are.
OTHERS = [
    "Electro", "Electroclash", "IDM", "Leftfield", "Synthwave", "Synth-pop", "Vaporwave", "Darkwave", "Eurodance", "Eurobeat", "Italodance", "New Beat",
    "New Wave", "Hip Hop", "Trap", "Bass Music", "Miami Bass", "Pop", "Rock", "R&B", "Soul", "Funk", "Reggae", "Dancehall", "Dub", "Latin", "Jazz", "Blues",
]
# Tag spellings and what they stand for.
ALIASES = {
    "Hip-Hop": "Hip Hop", "D&B": "Drum & Bass", "Rock & Roll": "Rock", "Synth Pop": "Synth-pop", "Nu Disco / Disco": "Nu-Disco", "Minimal / Deep Tech": "Minimal Techno",
    "Organic House / Downtempo": "Organic House", "Indie Dance / Nu Disco": "Indie Dance", "UK Garage / Bassline": "Bassline", "Bassline / Speed Garage": "Bassline",
    "Trap / Future Bass": "Trap",
}
# Tags that name no genre, and one that is used too loosely to be trusted.
GENERIC = [
    "", "unknown", "other", "others", "misc", "miscellaneous", "various", "electronic", "electronica", "dance", "dance/electronic", "dance / electronic", "dance/pop",
    "dance / pop", "dance/electronica", "dance / electronica", "electronica/dance", "electronica / dance", "edm", "club", "club/dance", "pop", "music", "untagged",
    "no genre", "électronique", "electronique",
]
UNTRUSTED = [*GENERIC, "electro"]
# Label categories that name the genre themselves where it has no parent.
CATEGORY_NAMES = {"Funk / Soul": "Funk/Soul", "Hip Hop": "Hip Hop", "Rock": "Rock", "Pop": "Pop", "Reggae": "Reggae"}
# Genres that pages may give, the longest match first among those found.
VOCABULARY = [
    "Tech House", "Bass House", "Deep House", "Progressive House", "Melodic House & Techno", "Funky House", "Afro House", "Future House", "Electro House", "Organic House",
    "House", "Techno", "Minimal", "Trance", "Psytrance", "Drum & Bass", "Dubstep", "Melodic Dubstep", "Midtempo Bass", "Nu-Disco", "Disco", "Indie Dance", "Future Rave",
    "Big Room", "Electronica", "Electro", "Breaks", "Hardstyle", "Hardcore", "Pop", "Hip Hop", "Trap",
]
# Words that narrow a genre without naming another.
QUALIFIERS = [
    "progressive", "melodic", "deep", "dark", "hard", "soulful", "funky", "jackin", "uplifting", "vocal", "acid", "liquid", "classic", "club", "music", "genre",
    "genres", "style", "styles", "and", "the", "of",
]
# Domains by how far their pages are trusted, X never.
TIERS = {"X": ["rateyourmusic.com"], "A": ["beatport.com", "traxsource.com"], "B": ["discogs.com", "junodownload.com", "beatsource.com"]}
# Sales buckets that name no music, as whole fields and as phrases in one.
BUCKETS = ["electronic", "dance", "edm", "pop", "electronica dance", "dance electronic", "electronic dance music", "music", "other"]
BUCKET_PHRASES = ["dance pop", "dance electronic", "edm", "electronic dance"]


def fold(name: str) -> str:
    """Names are looked up whatever their case and spacing."""
    return " ".join(name.split()).lower()


#: Parent of every subgenre, under its own and its shown name.
PARENT_OF = {s: p for p, subs in PARENTS.items() for s in subs}
PARENT_OF |= {SHOWN_AS[s]: p for s, p in PARENT_OF.items() if s in SHOWN_AS and SHOWN_AS[s] not in PARENT_OF}
_NAMES = [*(n for p, subs in PARENTS.items() for n in (p, *subs)), *SHOWN_AS, *OTHERS]
#: The tables' own spelling of every known name; their own names go before those that are only shown.
SPELLING = {fold(n): n for n in (*reversed(list(SHOWN_AS.values())), *reversed(_NAMES))}
ALIAS_OF = {fold(k): v for k, v in ALIASES.items()}

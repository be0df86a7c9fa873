"""The vocabulary that queries, tags and generated data share. Fixed values, in their fixed order."""

GENRES = ["pop", "rock", "hip-hop", "electronic", "jazz", "classical", "country", "r&b", "reggae", "metal", "folk", "indie", "latin", "blues"]
GENRE_SYNONYMS = {
    "rap": "hip-hop", "hiphop": "hip-hop", "rnb": "r&b", "r&amp;b": "r&b", "edm": "electronic", "electro": "electronic",
    "dance": "electronic", "classic": "classical", "orchestral": "classical", "acoustic-folk": "folk", "hard rock": "rock",
}
MOODS = ["happy", "sad", "energetic", "chill", "aggressive", "romantic", "melancholic", "uplifting", "dreamy", "tense", "nostalgic", "playful"]
# Moods that say something about a feature: (moods, feature, operator, threshold).
MOOD_HINTS = [
    (["happy", "uplifting", "playful"], "valence", ">", 0.6),
    (["sad", "melancholic", "nostalgic"], "valence", "<", 0.4),
    (["energetic", "aggressive", "tense"], "energy", ">", 0.7),
    (["chill", "dreamy"], "energy", "<", 0.4),
]
ADJECTIVES = {
    "upbeat": ("valence", ">", 0.6), "fast": ("tempo", ">", 120.0), "slow": ("tempo", "<", 90.0),
    "acoustic": ("acousticness", ">", 0.6), "instrumental": ("instrumentalness", ">", 0.5),
    "danceable": ("danceability", ">", 0.6), "loud": ("loudness", ">", -6.0), "quiet": ("loudness", "<", -12.0),
}
MOOD_KEYWORDS = {
    "happy": "upbeat,feel-good,positive", "sad": "melancholic,emotional,sad", "energetic": "high energy,energetic,intense",
    "chill": "relaxing,mellow,chill", "aggressive": "aggressive,intense,hard", "romantic": "romantic,love,acoustic",
    "melancholic": "melancholic,emotional,dark", "uplifting": "uplifting,inspiring,positive", "dreamy": "dreamy,atmospheric,ambient",
    "tense": "tense,dark,intense", "nostalgic": "nostalgic,retro,classic", "playful": "playful,fun,upbeat",
}
# Search keyword of a crawl -> genre; a keyword that is not here, or whose genre is not in GENRES, is DEFAULT_GENRE.
KEYWORD_GENRES = {
    "pop": "pop", "pop music": "pop", "pop rock": "pop", "dance pop": "pop",
    "rock": "rock", "rock music": "rock", "hard rock": "rock", "alternative rock": "indie",
    "jazz": "jazz", "jazz music": "jazz", "smooth jazz": "jazz", "jazz fusion": "jazz",
    "hip-hop": "hip-hop", "hip hop": "hip-hop", "rap": "hip-hop", "hip-hop music": "hip-hop",
    "country": "country", "country music": "country", "country rock": "rock", "americana": "country",
    "electronic": "electronic", "edm": "electronic", "house": "electronic", "dance": "electronic", "techno": "electronic",
    "indie": "indie", "indie pop": "indie", "indie rock": "indie", "alternative": "indie",
    "classical": "classical", "classical music": "classical", "symphony": "classical", "piano": "classical",
    "folk": "folk", "folk music": "folk", "acoustic": "folk", "singer-songwriter": "folk",
    "metal": "metal", "heavy metal": "metal", "rock metal": "metal", "metal music": "metal",
    "reggae": "reggae", "reggae music": "reggae", "dub": "reggae", "dancehall": "reggae",
    "blues": "blues", "blues music": "blues", "electric blues": "blues", "blues rock": "blues",
    "r&b": "r&b", "rnb": "r&b", "r&b music": "r&b", "soul music": "soul",
    "soul": "soul", "funk": "soul", "neo-soul": "soul",
}
DEFAULT_GENRE = "indie"
# Genre of an artist as another source writes it -> genre; the order matters for matches inside a longer name.
ARTIST_GENRES = {
    "pop": "pop", "rock": "rock", "jazz": "jazz", "hip-hop": "hip-hop", "hip hop": "hip-hop", "rap": "hip-hop", "country": "country",
    "electronic": "electronic", "edm": "electronic", "house": "electronic", "dance": "electronic", "indie": "indie", "indie pop": "indie",
    "indie rock": "indie", "alternative": "indie", "classical": "classical", "folk": "folk", "acoustic": "folk", "metal": "metal",
    "heavy metal": "metal", "reggae": "reggae", "blues": "blues", "r&b": "r&b", "rnb": "r&b", "soul": "soul",
}

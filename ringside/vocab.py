"""Fixed vocabularies of the directory.

Everything here is a fixed value of the data model: it must equal what the published
datasets use for results to match, so it is written out plainly.
"""

# --- fixed values: column names of the census -------------------------------------------
CENSUS_FIELDS = [
    "inst_numero", "inst_nom", "inst_adresse", "inst_cp", "new_name", "new_code",
    "dep_code", "dep_nom", "reg_nom", "inst_uai", "equip_numero", "equip_nom",
    "equip_type_name", "equip_coordonnees", "equip_sol", "equip_nature", "equip_piste_nb",
    "equip_piste_long", "equip_eclair", "equip_acc_libre", "equip_ouv_public_bool",
    "equip_douche", "equip_vest_sport", "equip_sanit", "equip_trib_nb", "equip_url",
    "equip_service_date", "equip_travaux_date", "equip_prop_type", "equip_gest_type",
]
CENSUS_FAMILY = "Equipement d'athlétisme"

# --- fixed values: surface labels (accent-free, lower case) -> surface code --------------
SURFACE_OF_LABEL = {
    "synthetique (hors gazon)": "synthetique",
    "synthetique": "synthetique",
    "tartan": "synthetique",
    "bitume": "bitume",
    "beton": "bitume",
    "stabilise/cendree": "cendree",
    "stabilise / cendre": "cendree",
    "terre battue": "cendree",
    "sable": "sable",
    "gazon naturel": "gazon",
    "gazon synthetique": "gazon",
    "surface naturelle": "naturel",
    "parquet": "interieur",
    "carrelage": "interieur",
    "dalles en polypropylene": "interieur",
    "sciure/copeaux": "naturel",
}
SURFACES = ["synthetique", "bitume", "cendree", "sable", "gazon", "naturel", "interieur"]
SURFACE_ENGLISH = {
    "synthetique": "synthetic", "bitume": "asphalt", "cendree": "cinder", "sable": "sand",
    "gazon": "grass", "naturel": "natural", "interieur": "indoor",
}

# --- fixed values: disciplines read from free text ---------------------------------------
DISCIPLINE_PATTERNS = [
    ("triple", r"triple[- ]?saut|triplesaut"),
    ("perche", r"\bperche"),
    ("hauteur", r"\bhauteur"),
    ("longueur", r"longueur|longeur"),
    ("poids", r"\bpoids\b"),
    ("disque", r"\bdisque"),
    ("marteau", r"\bmarteau"),
    ("javelot", r"\bjavelot"),
    ("steeple", r"steeple"),
]
DISCIPLINES = ["longueur", "triple", "hauteur", "perche", "poids", "disque", "marteau",
               "javelot", "steeple"]
JUMPS = ["longueur", "hauteur", "perche", "triple"]
THROWS = ["poids", "disque", "marteau", "javelot"]
UNKNOWN_JUMP, UNKNOWN_THROW = "saut_indetermine", "lancer_indetermine"
DISPLAY_ORDER = ["steeple", "longueur", "triple", "hauteur", "perche", "poids", "disque",
                 "marteau", "javelot"]
DISCIPLINE_OF_PARAM = {
    "long_jump": "longueur", "triple_jump": "triple", "high_jump": "hauteur",
    "pole_vault": "perche", "shot_put": "poids", "discus": "disque", "hammer": "marteau",
    "javelin": "javelot", "steeplechase": "steeple",
}

# --- fixed values: census types and natures ----------------------------------------------
TRACK_TYPES = ["Stade d’athlétisme", "Stade d'athlétisme", "Piste d'athlétisme isolée",
               "Piste d'athlétisme 2 à 4 couloirs"]
COVERED_NATURES = ["Intérieur", "Extérieur couvert", "Découvrable"]
SMALL_WORDS = ["de", "du", "des", "d", "le", "la", "les", "l", "et", "a", "au", "aux", "en",
               "sur", "sous", "par", "pour", "lez", "les-"]

# --- fixed values: keys of a community patch, by type ------------------------------------
PATCH_STRINGS = ["nom", "adresse", "cp", "ville", "dep", "dep_nom", "region", "surface", "url",
                 "horaires", "acces_note", "note", "proprietaire", "gestionnaire"]
PATCH_BOOLS = ["piste", "couvert", "eclairage", "acces_libre", "ouvert_public", "vestiaires",
               "douches", "sanitaires", "scolaire", "supprime"]
PATCH_INTS = ["couloirs", "longueur_piste", "longueur_probable", "tribunes", "annee",
              "renovation"]
PATCH_NUMBERS = ["lat", "lon"]
PATCH_LISTS = ["agres", "agres_probables"]
PATCH_MEDIA = ["photos", "avis"]
PATCH_KEYS = (PATCH_STRINGS + PATCH_BOOLS + PATCH_INTS + PATCH_NUMBERS + PATCH_LISTS
              + PATCH_MEDIA)
# the validator tolerates one key that the build refuses
VALIDATOR_ONLY_STRINGS = ["photo"]
PHOTO_KEYS = ["fichier", "legende", "credit"]
REVIEW_KEYS = ["auteur", "date", "note", "texte"]
ID_PATTERN = r"^(I[0-9A-Z]{9,}|c-[a-z0-9-]{3,60})$"

# --- fixed values: published keys --------------------------------------------------------
SHORT_KEY = {
    "id": "i", "nom": "n", "adresse": "a", "cp": "cp", "ville": "v", "dep": "d", "lat": "y",
    "lon": "x", "piste": "p", "couloirs": "cl", "longueur_piste": "lp",
    "longueur_probable": "lpp", "surface": "s", "couvert": "cv", "eclairage": "ec",
    "acces_libre": "al", "ouvert_public": "op", "vestiaires": "ve", "douches": "du",
    "sanitaires": "wc", "tribunes": "tr", "agres": "g", "agres_probables": "gp",
    "nb_sautoirs": "ns", "nb_aires_lancer": "nl", "annee": "an", "renovation": "rn",
    "url": "u", "scolaire": "sc", "source": "sr", "horaires": "h", "acces_note": "na",
    "note": "no", "photos": "ph", "avis": "av", "note_moyenne": "nt", "nb_avis": "nv",
}
SOURCE_CODE = {"res": 0, "res+communaute": 1, "communaute": 2}
COMMUNITY_SOURCE = 2
DEFAULT_FALSE = ["piste", "couvert", "eclairage", "acces_libre", "ouvert_public", "vestiaires",
                 "douches", "sanitaires", "scolaire"]

# --- fixed values: words of published sentences, tags and records -------------------------
SENTENCES = {
    "is_in": {"fr": " est un équipement d'athlétisme situé à ", "en": ' is an athletics venue in '},
    "in_region": {"fr": ', en ', "en": ', '},
    "end": {"fr": '.', "en": ', France.'},
    "offers": {"fr": 'On y trouve ', "en": 'It also offers '},
    "floodlighting": {"fr": "l'éclairage", "en": 'floodlighting'},
    "indoor": {"fr": 'une piste couverte', "en": 'an indoor track'},
    "changing_rooms": {"fr": 'des vestiaires', "en": 'changing rooms'},
    "showers": {"fr": 'des douches', "en": 'showers'},
    "provides": {"fr": 'Le site propose ', "en": 'The venue provides '},
    "free": {"fr": "L'accès est libre.", "en": 'Access is free and unrestricted.'},
    "public": {"fr": 'Le site est ouvert au public sur certains horaires.', "en": 'The venue is open to the public at set times.'},
}
# what it has, before its length, without a length, before its surface, what it is, before and after its lanes
TRACK_WORDS = {"fr": ("Il dispose d'une piste", " de ", "", " en ", "", ", à ", " couloirs"),
               "en": ("It has a", " ", "n", " ", " running track", " with ", " lanes")}
DESCRIPTION_WORDS = {"fr": ("Piste ", "Piste d'athlétisme", " couloirs", "éclairée", "accès libre", " : "),
                     "en": ("Track ", "Running track", " lanes", "floodlit", "free access", " — ")}
TAG_WORDS = {"fr": {"free": "Accès libre", "indoor": "Couverte", "school": "Site scolaire", "lanes": " couloirs",
                    "jumps": (" aire de saut", " aires de saut"), "throws": (" aire de lancer", " aires de lancer")},
             "en": {"free": "Free access", "indoor": "Indoor", "school": "School venue", "lanes": " lanes",
                    "jumps": (" jump area", " jump areas"), "throws": (" throwing area", " throwing areas")}}
SERVICE_NAMES = {"fr": ("Éclairage", "Vestiaires", "Douches", "Sanitaires", "Couverte / indoor"),
                 "en": ("Floodlighting", "Changing rooms", "Showers", "Toilets", "Covered / indoor")}
PROPERTY_NAMES = {"fr": ("Revêtement", "Développement", "Couloirs"), "en": ("Surface", "Lap length", "Lanes")}
ESTIMATE_NOTE = "Développement estimé à %d m d'après le tracé de l'anneau dans OpenStreetMap (%s), non mesuré sur place."

# --- fixed value: address of a mapped object ---------------------------------------------
OBJECT_URL = "https://www.openstreetmap.org/"

# --- fixed values: mapped objects --------------------------------------------------------
CONTEST_TAGS = ["long_jump", "triple_jump", "high_jump", "pole_vault", "shot_put",
                "discus_throw", "javelin_throw", "hammer_throw"]
ATHLETICS_SPORTS = ["athletics", "running"]
STANDARD_LAPS = [200, 250, 300, 333, 400]
SCHOOL_AMENITIES = ["school", "kindergarten", "college"]
PLACE_CLASSES = [("leisure", ["sports_centre", "stadium"]), ("amenity", SCHOOL_AMENITIES),
                 ("leisure", ["track", "pitch", "park", "playground"])]
SOURCE_NAMED, SOURCE_ROAD, SOURCE_PITCH = ("OSM (equipement nomme)", "OSM (voie)",
                                           "BD TOPO (city-stade)")
MULTISPORT_PITCH, DEFAULT_PITCH_NAME = "Petit terrain multi-sports", "Plateau multisports"

# --- fixed values: labels per language ---------------------------------------------------
SURFACE_LABEL = {
    "fr": {"synthetique": "Synthétique (tartan)", "bitume": "Bitume / goudron",
           "cendree": "Cendrée / stabilisé", "sable": "Sable", "gazon": "Gazon",
           "naturel": "Surface naturelle", "interieur": "Sol intérieur"},
    "en": {"synthetique": "Synthetic (tartan)", "bitume": "Asphalt / tarmac",
           "cendree": "Cinder / gravel", "sable": "Sand", "gazon": "Grass",
           "naturel": "Natural surface", "interieur": "Indoor flooring"},
}
DISCIPLINE_LABEL = {
    "fr": {"longueur": "Sautoir longueur", "triple": "Triple saut",
           "hauteur": "Sautoir hauteur", "perche": "Sautoir à la perche",
           "poids": "Lancer du poids", "disque": "Lancer du disque",
           "marteau": "Lancer du marteau", "javelot": "Lancer du javelot",
           "steeple": "Steeple", "saut_indetermine": "Aire de saut (type inconnu)",
           "lancer_indetermine": "Aire de lancer (type inconnue)"},
    "en": {"longueur": "Long jump pit", "triple": "Triple jump", "hauteur": "High jump area",
           "perche": "Pole vault", "poids": "Shot put", "disque": "Discus",
           "marteau": "Hammer throw", "javelot": "Javelin", "steeple": "Steeplechase",
           "saut_indetermine": "Jump area (type unknown)",
           "lancer_indetermine": "Throwing area (type unknown)"},
}
MONTHS = {
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
           "septembre", "octobre", "novembre", "décembre"],
    "en": ["January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December"],
}
YES = {"fr": "Oui", "en": "Yes"}
NO = {"fr": "Non", "en": "No"}

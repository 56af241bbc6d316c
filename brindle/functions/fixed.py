"""Lists, tables, constants and patterns that results must agree on."""

# --- fixed values: languages of regions ---
CANTON_LANGUAGE = {
    "AG": "de", "AI": "de", "AR": "de", "BE": "de", "BL": "de", "BS": "de", "FR": "fr", "GE": "fr", "GL": "de",
    "GR": "de", "JU": "fr", "LU": "de", "NE": "fr", "NW": "de", "OW": "de", "SG": "de", "SH": "de", "SO": "de",
    "SZ": "de", "TG": "de", "TI": "it", "UR": "de", "VD": "fr", "VS": "fr", "ZG": "de", "ZH": "de",
}
# canton|district and canton|municipality, in lower case
DISTRICT_LANGUAGE = {
    "be|jura bernois": "fr", "be|biel/bienne": "de", "fr|sense": "de", "fr|see": "de", "fr|lac": "de",
    "vs|goms": "de", "vs|brig": "de", "vs|visp": "de", "vs|raron": "de", "vs|westlich raron": "de",
    "vs|östlich raron": "de", "vs|leuk": "de", "gr|moesa": "it", "gr|bernina": "it",
}
MUNICIPALITY_LANGUAGE = {"gr|bregaglia": "it", "fr|courtepin": "fr", "fr|misery-courtion": "fr", "fr|mont-vully": "fr"}

# --- fixed values: numbers ---
REFERENCE_YEAR = 2026
QUANTILE_LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
ACCESS_WEIGHTS = {
    "supermarket": [3.0],
    "restaurant": [0.75, 0.45, 0.25, 0.25, 0.225, 0.225, 0.225, 0.225, 0.2, 0.2],
}
GREEN_CLASSES = (5, 10, 11, 12)
NOISE_RINGS = (0.0, 10.0, 20.0, 50.0, 100.0)
NOISE_FACADE = 20.0

# --- fixed values: stop words for the language vote ---
STOP_WORDS = {
    "de": (
        "der die das und ist mit von zu im den dem ein eine einer nicht auf für sich auch wir sie bei nach aus wird "
        "sind oder zum zur sehr ihr wohnung zimmer küche miete ruhige grosse schöne neu hell"
    ).split(),
    "fr": (
        "et est avec du une pour dans au aux sur par pas vous nous sont très appartement pièces cuisine loyer ce cette "
        "les à grand belle lumineux quartier proche"
    ).split(),
    "it": (
        "lo gli è con di del della dei una nel nella sono molto appartamento locali cucina affitto che al alla delle "
        "luminoso bello vicino"
    ).split(),
    "en": (
        "the and is with of to for this are be apartment flat room kitchen rent bedroom located near bright large"
    ).split(),
}
TOKEN = r"[a-zäöüàâçéèêëîïôûùìíòóú]+"

# --- fixed values: keyword patterns, on lower-cased text ---
KEYWORDS = {
    "balcony": r"balkon|balcon|loggia",
    "terrace": r"terrass|terrazz|sitzplatz|patio",
    "lift": r"(?<!ski)(?<!sessel)lift\b|aufzug|fahrstuhl|ascenseur|ascensore|elevator",
    "lake_view": r"see-?\s?(?:sicht|blick)|sicht auf den \w*see|vue\W+(?:\w+\W+){0,3}lac\b|vista\W+(?:\w+\W+){0,3}lago\b|lake view",
    "mountain_view": r"berg(?:sicht|blick)|alpen(?:sicht|blick|panorama)|sicht auf die (?:berge|alpen)|vue\W+(?:\w+\W+){0,3}(?:montagnes?|alpes)\b|vista\W+(?:\w+\W+){0,3}(?:montagn[ae]|monti|alpi)\b|mountain view",
    "renovated": r"r[ée]nov|saniert|sanierung|moderni[sz]iert|ristruttur|rinnov",
    "new_build": r"neubau|erstbezug|nouvelle construction|construction neuve|premi[èe]re location|immeuble neuf|appartement neuf|nuova costruzione|prima locazione|new build|newly built",
    "furnished": r"(?<!un)(?<!nicht )m(?:ö|oe|o)bliert|(?<!non )(?<!non-)(?<!pas )meubl[ée]|(?<!non )(?<!non-)arredat|(?<!un)furnished",
    "temporary": r"(?<!un)(?<!nicht )befristet|tempor[äa]r|zwischenmiete|auf zeit\b|dur[ée]e d[ée]termin[ée]e|temporaire|courte dur[ée]e|temporane|tempo determinato|breve periodo|temporary",
    "parking": r"parkpl[äa]tz|abstellplatz|place de parc|places de parc|parking|posteggi|parcheggi|posto auto",
    "garage": r"garage|einstellhalle|einstellplatz|tiefgarage|autorimessa|box auto",
    "minergie": r"minergie",
    "pets": r"haustier|\bkatzen?\b|\bhunde?\b|animaux|animali|\bchats?\b|\bchiens?\b|\bpets?\b",
    "garden": r"(?<!kinder)garten(?!\w*(?:strasse|str\b|weg\b|gasse))|jardin|giardin|garden",
    "dishwasher": r"geschirrsp[üu]e?l|abwaschmaschine|sp[üu]lmaschine|lave-vaisselle|lavastoviglie|dishwasher",
    "own_washer": r"waschturm|eigene\w*\s+(?:waschmaschine|wm\b|waschk[üu]che)|wm\s*/\s*(?:tumbler|tr)\b|waschmaschine\s*(?:und|/|&)\s*tumbler|colonne de lavage|(?:lave-linge|machine [àa] laver)\s+(?:priv|individ|dans l)|colonna (?:di )?lavaggio|lavatrice\s+(?:propri|privat|in appartamento)|own washer",
    "fireplace": r"kamin|schwedenofen|chemin[ée]e|caminett|\bcamino\b|fireplace",
    "attic": r"dachwohnung|dachgescho|dachstock|mansard|attika|combles|sous les toits|attique|sottotetto|attico|attic|penthouse",
    "loft": r"\bloft",
    "quiet": r"ruhig|calme|tranquill|silenzios|quiet",
    "cooperative": r"genossenschaft|coop[ée]rative|cooperativa|anteilschein|parts? sociales?|quot[ae] social[ei]",
    "subsidised": r"subventio|verbillig|kostenmiete|gemeinn(?:ü|ue)tzig|loyer mod[ée]r|\blup\b|sussidi|pigione moderata|canone moderato|alloggi popolari",
    "shared_flat": r"\bwg\b(?![-\s]?(?:tauglich|geeignet))|wohngemeinschaft|mitbewohner|untermiet|colocat|\bcoloc\b|coinquilin|appartamento condiviso|shared flat|flatshare",
    "wheelchair": r"rollstuhl|hindernisfrei|behindertengerecht|barrierefrei|fauteuil roulant|sans obstacle|sedia a rotelle|senza barriere|wheelchair",
}

# --- fixed values: patterns of contact data and amounts ---
THOUSANDS = r"\d{1,3}(?:['’ .,]\d{3})+(?!\d)"
NUMBER = rf"(?:{THOUSANDS}|\d{{2,6}})(?:[.,]\d{{1,2}})?(?![\d'’])"
NUMBER_3 = rf"(?:{THOUSANDS}|\d{{3,6}})(?:[.,]\d{{1,2}})?(?![\d'’]|[.,]\d)"
DASH = r"(?:\s*[.,]\s*[-–—]+)"
CURRENCY = r"(?:(?:CHF|SFr|Frs|Fr|Franken|francs?|franchi|EUR|Euro)(?:\.|(?=\d)|\b)|€)"
AMOUNT_START = r"(?<![\w'’.,])"
EMAIL = r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{1,63}){0,10}\.[a-z]{2,24}"
URL = (
    r"(?:https?://|www\.)[^\s<>\"]{0,2000}[^\s<>\".,;:!?)\]]|(?<![\w-])[\w-]{1,63}"
    r"(?:\.[\w-]{1,63}){0,10}\.(?:ch|com|net|org|swiss|info|li)\b(?:/[^\s<>\"]{0,2000}[^\s<>\".,;:!?)\]])?"
)
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,4})?\b"
PHONE = (
    r"(?<![\w+'’.,])(?:\+|00)\s?[1-9]\d{0,2}(?:\s?\(0\))?(?:[\s./-]{0,2}\d){6,12}(?!\d)"
    r"|(?<![\w+'’.,])\(?0\d{2}\)?(?:[\s./-]{0,3}\d){7}(?!\d)"
)
PRICES = (
    rf"(?>{CURRENCY}\s*:?\s*{NUMBER}{DASH}?(?:\s*(?:-|–|bis|à)\s*{NUMBER}{DASH}?)?)(?!\s*(?:uhr|h\b|heures?|ore\b))",
    rf"{AMOUNT_START}{NUMBER}{DASH}?\s*{CURRENCY}",
    rf"{AMOUNT_START}{NUMBER}{DASH}(?!\w)",
    rf"{AMOUNT_START}{NUMBER_3}{DASH}?(?=\s*(?:/\s*|(?:pro|par|per|al|im|a)\s+)(?:mte?\b|monat|mois|mese|month)"
    r"|\s+(?:monatlich|mensuel|mensil|netto|brutto|(?:inkl|exkl|zzgl)\.?\s*nk))",
)
PRICE_CUES = (
    r"\w*(?:miete|mietzins|mietpreis|preis|kosten|depot|kaution)|NK|HK|akonto|pauschale|garantie|netto|brutto|mtl|"
    r"monatlich|pro monat|total|einstellplatz|einstellhallenplatz|(?:auto|aussen)?parkplatz|abstellplatz|garagenplatz|"
    r"garage|loyer(?: net| brut)?|prix|charges|frais|acompte|caution|dépôt|place de parc|parking|par mois|affitto|"
    r"pigione|canone|prezzo|spese|acconto|deposito|cauzione|garanzia|posteggio|parcheggio|al mese|rent|price|deposit"
)
NOT_AMOUNT_UNIT = r"(?!\s*(?:m2|m²|m\b|qm|%|zimmer|zi\b|pi[èe]ces?|locali|jahre?|ans?\b|anni))"
CUE_GAP = (
    r"(?:(?!(?<=[^\W\d_]{5})\.\s+(?-i:[A-ZÄÖÜ]))[^\d\n\[]"
    r"|\d+(?:[.,]\d)?\s*-?\s*(?:zimmer|zi\b|pi[èe]ces?|locali|m2|m²)){0,30}?"
)
YEAR_CONTEXT = (
    r"baujahr|jahrgang|renov|r[ée]nov|sanier|erbaut|gebaut|bezug|constru|ristrutt|costru|ann[ée]e|abrechnung|d[ée]compte"
    r"|\b(?:seit|depuis|since|built|anno|nel|dal|jan(?:uar)?|feb(?:ruar)?|m[äa]rz|apr(?:il)?|mai|juni?|juli?|aug(?:ust)?"
    r"|sept?(?:ember)?|okt(?:ober)?|nov(?:ember)?|dez(?:ember)?|janvier|f[ée]vrier|mars|avril|juin|juillet|ao[uû]t"
    r"|septembre|octobre|novembre|d[ée]cembre|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre"
    r"|dicembre|frühling|sommer|herbst|ende|anfang|mitte|printemps|été|automne|hiver|fin|début|primavera|autunno|inverno"
    r"|fine|inizio)\b"
)
POSTCODE_LEAD = r"(?:,|\bin|\bà|\bCH-)\s*$"
POSTCODE_TAIL = rf"[ \t]+(?!(?i:{PRICE_CUES}|franken|fr|euro|monat|mte?|plus|inkl|exkl|zzgl)\b)[A-ZÄÖÜ][a-zäöüéèà]"
UPPER = "A-ZÄÖÜÀÂÇÈÉÊÎÔÙÛ"
SALUTATION = (
    r"\b(?:Herrn?|Frau|Hr\.|Fr\.|Monsieur|Madame|Mademoiselle|MM?\.|Mmes?\.?|Mlle\.?|"
    r"Signor(?:a|e|ina)?|Sig\.(?:ra|na)?|Dott\.(?:ssa)?|Mrs?\.?|Ms\.?)"
)
TITLE = r"(?:(?:Dr|Prof|Ing|Dipl|lic|Dott)\.[ \t]*)*"
PARTICLE = r"(?:(?:von|van|de|di|da|del|della|du|le|la)[ \t]+(?:(?:der|den|dem|des|la|le)[ \t]+)?)?"
CONTACT_CUE = (
    r"\b(?i:kontakt(?:person)?|ansprechperson|ansprechpartner(?:in)?|contact|personne de contact|contatto|"
    r"persona di contatto|referente)\s*:?\s*"
)
ANY_NUMBER = r"(?<![\d'’.,])(?:\d{1,3}(?:['’ .,]\d{3})+(?!\d)|\d+)(?:[.,]\d{1,2})?(?!\d)"

# --- fixed values: address parts ---
COUNTRIES = ("schweiz", "suisse", "svizzera", "switzerland", "ch")
COUNTRY_PREFIX = r"(?:CH\s*-\s*)?"
HOUSE_NUMBER = r"\d{1,4}\s?[a-z]?(?:\s?[-/]\s?\d{1,4}\s?[a-z]?)*(?:\s?(?:bis|ter))?"

# --- fixed values: street abbreviations, on normalised text ---
STREET_WORDS = {r"str\b": "strasse", r"\brte\b": "route", r"\bave?\b": "avenue", r"\bch\b": "chemin", r"\bbd\b": "boulevard", r"\bpl\b": "place"}

# --- fixed values: attributes of a text, on lower-cased text ---
ROOM_COUNT = (
    r"(?<![\d.,'’/])(?P<num>\d{1,2}(?:[.,][05])?)(?P<half>\s?(?:½|1/2))?\s*-?\s*"
    r"(?:zimmer|zi\b\.?|pi[èe]ces?|pces?\b|locali|locale|vani|rooms?)"
)
STUDIO = r"\b(?:studio|monolocale|einzimmerwohnung)\b"
AREA = (
    r"(?<![\d.,'’])(?P<num>\d{2,3}(?:[.,]\d{1,2})?)\s*"
    r"(?:m2|m²|m\s2\b|qm|sqm|mq|quadratmeter|mètres carrés|metri quadrati)"
)
LIVING_AREA = r"wohnfl|fl[äa]che|surface|superficie|gr[öo](?:ss|ß)e|living"
OTHER_AREA = (
    r"garten|terrass|balkon|sitzplatz|grundst|keller|estrich|hobby|bastel|lager|büro|atelier|"
    r"jardin|balcon|cave|terrain|parcelle|giardin|terrazz|cantina"
)
DWELLING = r"wohnung|whg|zimmer|appartement|pi[èe]ces|logement|appartamento|locali|alloggio|apartment"
ORDINALS = {
    "erste": 1, "zweite": 2, "dritte": 3, "vierte": 4, "fünfte": 5, "premier": 1, "première": 1, "deuxième": 2,
    "troisième": 3, "quatrième": 4, "cinquième": 5, "primo": 1, "secondo": 2, "terzo": 3, "quarto": 4, "quinto": 5,
}
FLOOR_NUMBERS = (
    r"(?<![\d.])(?P<n>\d{1,2})\.\s?(?:og|obergescho(?:ss|ß)|stock(?:werk)?\b|etage)",
    r"(?<![\d.])(?P<n>\d{1,2})\s?(?:e|er|ère|ème|eme)\s+[ée]tage",
    r"(?<![\d.])(?P<n>\d{1,2})\s?[°º]?\s?piano\b",
)
FLOOR_ORDINAL = rf"(?<![a-zäöüéè])(?P<n>{'|'.join(ORDINALS)})[nmr]?\s+(?:stock|obergescho|[ée]tage|piano)"
GROUND_FLOOR = r"erdgescho(?:ss|ß)|\beg\b|parterre|rez-de-chauss[ée]e|piano terr[ae]|pianterreno"
CLAUSE_END = r"[,;:\n!?()]|\.\s"
RENOVATED = r"(?:r[ée]nov\w*|\w*saniert|sanierung|moderni[sz]iert|ristruttur\w*|rinnov\w*|umgebaut)"
NOT_BUILT = r"(?!baujahr|erbaut|gebaut|construit|construction|costruit|built)"
RENOVATED_IN = rf"{RENOVATED}(?:{NOT_BUILT}[^.\n\d]){{0,30}}?(?P<y>(?:19|20)\d{{2}})\b"
IN_RENOVATED = rf"\b(?P<y>(?:19|20)\d{{2}})[^.,;\n\d]{{0,15}}?{RENOVATED}"
NEGATION = r"\b(?:kein\w*|nicht|ohne|pas|sans|non|aucun\w*|nessun\w*|senza|niente|no|not|without)\b"
NEGATION_END = (
    r"[,;.:!?()\n]|\b(?:aber|jedoch|sondern|nur|mit|dafür|mais|avec|seulement|ma|con|solo|but|"
    r"with|only)\b"
)
DENIED_AFTER = r"\s*(?:[:?]\s*(?:nein|non|no|keine?)\b|nicht vorhanden|pas disponible|non disponibile)"
SHARED_ROOM = (
    r"\bwg[- ]?zimmer|zimmer in (?:einer |unserer |der )?(?:\d+er[- ]?)?(?:wg|wohngemeinschaft)\b"
    r"|zimmer (?:in|zur) untermiete|untermiete (?:eines|für ein|von einem) zimmer"
    r"|mitbewohner(?:in)? gesucht|such\w* (?:eine[nr]? )?(?:neue[nr]? )?mitbewohner"
    r"|chambre (?:en|dans une?) colocation|colocataire recherch|cherch\w* (?:une? )?colocataire"
    r"|(?:camera|stanza) in (?:appartamento condiviso|condivisione)|cerc\w* (?:una? )?coinquilin"
    r"|room in (?:a )?(?:shared flat|flatshare)|flatmate wanted"
)
ENUMS = {
    "view": (
        ("lake", KEYWORDS["lake_view"]),
        ("mountain", KEYWORDS["mountain_view"]),
        ("city", r"stadtblick|sicht auf die stadt|vue sur la ville|vista sulla citt|city view"),
        ("other", r"aussicht|weitsicht|fernsicht|panorama|vue d[ée]gag|vista aperta"),
    ),
    "parking": (("garage", KEYWORDS["garage"]), ("outdoor", KEYWORDS["parking"])),
    "rent_regime": (
        ("shared_flat", SHARED_ROOM),
        ("cooperative", KEYWORDS["cooperative"]),
        ("cost_based_or_subsidised", KEYWORDS["subsidised"]),
    ),
}
DENIALS = {
    "has_lift": r"(?:ohne|kein(?:en)?)\s+(?:lift|aufzug)|sans ascenseur|senza ascensore",
    "is_furnished": r"unm(?:ö|oe|o)bliert|nicht\s+m(?:ö|oe|o)bliert|non[- ]meubl|pas meubl|non[- ]arredat|unfurnished",
    "is_temporary": r"unbefristet|nicht\s+befristet|dur[ée]e ind[ée]termin|indeterminat",
    "pets_allowed": r"keine (?:haus)?tiere|tiere\s+(?:sind\s+)?nicht\s+(?:erlaubt|gestattet)|pas d'animaux|animaux (?:non|pas|interdit)|(?:niente|nessun|no)\s+animali|animali non|no pets",
    "has_own_washer": r"gemeinsame\w*\s+waschk|waschk[üu]che zur mitben|buanderie commune|lavanderia comune|shared laundry",
}
FLAGS = {
    "has_lift": KEYWORDS["lift"],
    "has_balcony_or_terrace": f"{KEYWORDS['balcony']}|{KEYWORDS['terrace']}",
    "is_furnished": KEYWORDS["furnished"],
    "is_temporary": KEYWORDS["temporary"],
    "is_minergie": KEYWORDS["minergie"],
    "pets_allowed": r"tiere\s+(?:sind\s+)?(?:erlaubt|willkommen|gestattet)|katzen erlaubt|animaux (?:admis|accept|bienvenu|autoris)|animali (?:ammessi|benvenuti|consentiti)|pets? (?:allowed|welcome)",
    "has_garden": KEYWORDS["garden"],
    "has_own_washer": KEYWORDS["own_washer"],
    "is_new_build": KEYWORDS["new_build"],
    "is_attic": KEYWORDS["attic"],
}

# fixed values: input range of an estimate, m2 and rooms; scores of public transport classes
AREA_RANGE = (10.0, 500.0)
ROOMS_RANGE = (1.0, 15.0)
TRANSIT_SCORE = {"A": 4, "B": 3, "C": 2, "D": 1}

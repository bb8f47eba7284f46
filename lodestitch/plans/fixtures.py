"""Small fixed tables: representative names and addresses of three countries and seven scripts, with their published canonical forms."""

from __future__ import annotations

#: Id, country, name, address, canonical name, script, canonical address, postal code or None.
CANONICAL = [
    ("S1-IN01", "India", "M/s Reliance Industries Pvt. Ltd.", "Near MG Road, Bangalore 560001", "reliance industries private ltd", "latin", "near mg road bangalore 560001", "560001"),
    ("S1-IN02", "India", "टाटा कंसल्टेंसी सर्विसेज लिमिटेड", "मुंबई महाराष्ट्र", "taataa kamsaltemsee sarviseja limiteda", "devanagari", "म बई मह र ष ट र", None),
    ("S1-IN03", "India", "ಕರ್ನಾಟಕ ಎಂಟರ್ಪ್ರೈಸಸ್", "ಬೆಂಗಳೂರು", "karnaataka emtarpraisas", "kannada", "ಬ ಗಳ ರ", None),
    ("S1-IN04", "India", "தமிழ்நாடு நிறுவனம்", "சென்னை 600001", "tamizhnaatu niruvanam", "tamil", "ச ன ன 600001", "600001"),
    ("S1-IN05", "India", "భారత్ ఎలక్ట్రానిక్స్ లిమిటెడ్", "హైదరాబాద్", "bhaarat elaktraaniks ltd", "telugu", "హ దర బ ద", None),
    ("S1-IN06", "India", "বাংলা ট্রেডার্স", "কলকাতা 700001", "baanglaa tredaarsa", "bengali", "কলক ত 700001", "700001"),
    ("S1-IN07", "India", "ગુજરાત ટેક્સટાઈલ્સ", "અમદાવાદ", "gujaraata teksataaeelsa", "gujarati", "અમદ વ દ", None),
    ("S1-IN08", "India", "കേരള ആയുർവേദ", "കൊച്ചി", "keerala aayuർveeda", "malayalam", "ക ച ച", None),
    ("S1-FR01", "France", "L'Oréal S.A.S.", "15 Boulevard Haussmann, 75440 CEDEX 09, Paris", "l oreal sas", "latin", "15 boulevard haussmann 75440 cedex 09 paris", "75440"),
    ("S1-FR02", "France", "Boulangerie Moderne E.U.R.L.", "12 1er étage, Boîte Postale 45, Lyon", "boulangerie moderne eurl", "latin", "12 1 etage bp 45 lyon", None),
    ("S1-FR03", "France", "Immobilier Parisien S.C.I.", "8 3ème Avenue, 75008 Paris", "immobilier parisien sci", "latin", "8 3 avenue 75008 paris", "75008"),
    ("S1-FR04", "France", "Transport Rapide S.N.C.", "BP 102, Marseille", "transport rapide snc", "latin", "bp 102 marseille", None),
    ("S1-US01", "US", "Google LLC & Co.", "1600 Amphitheatre Pkwy, Mountain View, CA 94043", "google llc and company", "latin", "1600 amphitheatre parkway mountain view ca 94043", "94043"),
    ("S1-US02", "US", "Acme Corporation", "", "acme corp", "latin", "", None),
    ("S1-US03", "US", "Smith & Sons Incorporated", "Suite 400, 5th Fl., New York, NY 10001", "smith and sons inc", "latin", "suite 400 5th floor new york ny 10001", "10001"),
]
RECORDS = [(i, n, a, c) for i, c, n, a, *_ in CANONICAL]

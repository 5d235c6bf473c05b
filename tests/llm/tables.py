SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, keep_id string"
ODD = [
    (1, "Alpha beta GAMMA delta epsilon zeta", "en", "src0", 35, 0.1, 7, "a"),
    (2, "alpha BETA gamma delta epsilon zeta", "en", "src0", 35, 0.2, 7, "a"),
    (2, "alpha BETA gamma delta epsilon zeta", "en", "src0", 35, 0.2, 7, "a"),
    (3, None, "de", "src1", None, None, None, None),
    (4, "", None, None, 0, 0.0, 0, ""),
    (5, " \n\t ", "fr", "src2", 4, 0.0, 0, ""),
    (6, "Écoute ÉCOUTE l'été 日本語 🙂 " * 3, "fr", "src2", 10, 0.0, 0, ""),
    (7, "word " * 60_000, "en", "src0", 300_000, 0.0, 0, ""),
    (None, "no id here at all, none", "en", "src3", 10, 0.0, 0, ""),
    (None, None, None, None, None, None, None, None),
    (8, "écoute", "fr", "src2", 6, 0.0, 0, ""),
    (9, "Écoute", "fr", "src2", 6, 0.0, 0, ""),
]

"""Training-data operators: personal data, sharding, tokenisation, quality, decontamination, near-duplicates, licences, language and secrets."""

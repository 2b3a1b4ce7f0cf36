"""Operations of a training-data pipeline: fingerprints, mixing, quality, near duplicates, packing, personal data, media, archives, main text, language."""

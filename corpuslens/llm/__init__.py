"""Training-data operators: licences, decontamination, language, secrets, packing, quality,
near-duplicates, web archives, repeated passages and sharding.  Nothing else imports this package."""

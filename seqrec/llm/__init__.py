"""Training-data operators: licence scan, mixing, chat formatting, quality, language, decontamination, dedup, URL and host rules."""

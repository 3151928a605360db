"""Operations on training text: counting, filtering, deduplication, mixing and archives."""

from pitgate.functions import classify, dates, identity, numbers, text

__all__ = ["classify", "dates", "identity", "numbers", "text"]

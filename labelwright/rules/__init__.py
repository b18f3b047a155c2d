from .history import RuleHistory, load_history
from .ruleset import RuleField, RuleSet, default_rules, load_rules

__all__ = ["RuleField", "RuleHistory", "RuleSet", "default_rules", "load_history", "load_rules"]

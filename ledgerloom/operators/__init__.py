"""DataFrame operators: profiles, rules, transforms, comparison, matching, validation."""

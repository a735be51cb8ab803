"""Token sets by name, statistics over tokens, and the catalog of registered queries."""

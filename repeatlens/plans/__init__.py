"""Reports made of several operators over shared intermediates."""

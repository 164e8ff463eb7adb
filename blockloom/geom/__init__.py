"""Planar geometry in numpy: shapes and their binary form, arrangements, inscribed circles, parcels."""

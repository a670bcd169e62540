"""askwright.sources"""

"""martline.sources"""

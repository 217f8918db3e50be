"""martline.streaming"""
